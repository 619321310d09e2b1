"""Registered queries (one per SURVEY §2 operator) and their DuckDB oracles.

Every query reads the driver tables (or data Spark derives from them by the
formulas in ``sources/tables.py``) in full. Doubles are rounded to 9
decimals and arrays joined with '|' on both sides so results hash alike.
"""

from __future__ import annotations

import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import report, rules_v1, rules_v2
from ..functions.rule_model import V1, V2
from ..functions.text import clean_text, normalise_text, truncated_tokens
from ..operators import aggregate as AG
from ..operators import evaluate as EV
from ..operators import lexicon as LX
from ..operators import prep as P
from ..operators import sample as S
from ..sources import lexicon_table
from ..sources import tables as T
from . import analyze as A
from . import oracle as O
from .oracle import D, q

R9 = 9


def r9(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, R9)


def sql_r9(x: str) -> str:
    return f"round({x}, {R9})"


def joined(c: Column) -> Column:
    return F.array_join(c, "|")


# ---------------------------------------------------------------------------
# shared inputs
# ---------------------------------------------------------------------------

def _planted(spark, sf):
    return T.planted(spark, sf)


def _comments(spark, sf):
    return T.comments(spark, sf)


def _training(spark, sf, version="v2"):
    """comments -> fill -> label -> (id, comment_text, label)."""
    return P.prepare_training_set(T.comments(spark, sf), version)


CAP = 20      # below the classes' sizes at every scale, so that the cap binds
DEBUG = 137


def _balanced(spark, sf):
    return S.balanced_sample(_training(spark, sf), cap=CAP, seed=S.SEED)


def _with_nulls(spark, sf):
    """Planted texts with a null every 17th and blank text every 19th document."""
    d = F.col("id")
    return _planted(spark, sf).select(
        "id",
        F.when(d % 17 == 0, F.lit(None).cast("string"))
        .when(d % 19 == 0, F.lit(" \n\t "))
        .otherwise(F.col("comment_text")).alias("comment_text"))


SQL_SRC = O.planted_cte()
SQL_NULLS = (f"{SQL_SRC}, nsrc AS (SELECT id, CASE WHEN id % 17 = 0 THEN NULL "
             f"WHEN id % 19 = 0 THEN ' ' || chr(10) || chr(9) || ' ' ELSE comment_text END AS comment_text FROM src)")


def _comments_sql() -> str:
    def nullif(cond, val):
        return f"CASE WHEN {cond} THEN NULL ELSE {val} END"

    def only(cond, val):
        return f"CASE WHEN {cond} THEN {val} ELSE NULL END"
    d = "doc_id"
    return f"""comments AS (SELECT {d} AS id, CAST({d} % 4 AS INTEGER) AS source_rank, text AS comment_text,
  {nullif(f'{d} % 13 = 0', f'({d} % 11) / {D(10)}')} AS target,
  {nullif(f'{d} % 9 = 0', f'({d} * 3 % 10) / {D(10)}')} AS identity_attack,
  ({d} * 7 % 10) / {D(20)} AS severe_toxicity,
  {nullif(f'{d} % 8 = 0', f'({d} * 13 % 9) / {D(10)}')} AS insult,
  ({d} % 5) / {D(10)} AS threat,
  {only(f'{d} % 5 = 0', f'({d} % 7) / {D(10)}')} AS black,
  {only(f'{d} % 6 = 1', f'({d} % 5) / {D(10)}')} AS white,
  {only(f'{d} % 7 = 2', f'({d} % 6) / {D(10)}')} AS asian,
  {only(f'{d} % 11 = 3', f'({d} % 9) / {D(10)}')} AS latino,
  {only(f'{d} % 13 = 4', f'({d} % 4) / {D(10)}')} AS other_race_or_ethnicity
 FROM documents)"""


NUMERIC = ["target", "identity_attack", "severe_toxicity", "insult", "threat",
           "black", "white", "asian", "latino", "other_race_or_ethnicity"]


def _filled_sql() -> str:
    cols = ", ".join(f"coalesce({c}, {D(0)}) AS {c}" for c in NUMERIC)
    return f"{_comments_sql()}, filled AS (SELECT id, source_rank, comment_text, {cols} FROM comments)"


def _label_sql(version: str) -> str:
    if version == "v1":
        m, t = P.V1_METRICS, P.V1_LABEL_THRESHOLD
    else:
        m, t = P.V2_METRICS, P.V2_LABEL_THRESHOLD
    return (f"CAST(greatest({', '.join(m)}) > {D(t)} AND "
            f"greatest({', '.join(P.RACE_COLUMNS)}) > {D(t)} AS INTEGER)")


def _training_sql(version: str = "v2") -> str:
    return (f"{_filled_sql()}, training AS (SELECT id, comment_text, {_label_sql(version)} AS label FROM filled)")


def _key_sql(seed: int = S.SEED) -> str:
    return f"md5(concat_ws(':', '{seed}', CAST(id AS VARCHAR)))"


def _balanced_sql() -> str:
    return f"""{_training_sql()},
counts AS (SELECT least(count_if(label = 0), count_if(label = 1), {CAP}) AS n FROM training),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_key_sql()}, id) AS rn FROM training),
balanced AS (SELECT id, comment_text, label FROM ranked, counts WHERE rn <= n)"""


def _annotations_sql() -> str:
    cols = []
    for name, mult in T.ANNOTATION_MULTIPLIERS.items():
        cols.append(f"CASE WHEN (doc_id + a) % 6 = 0 THEN NULL ELSE ((doc_id * {mult} + a * 5) % 10) / {D(10)} END AS {name}")
    return (f"ann AS (SELECT doc_id AS comment_id, {', '.join(cols)} "
            f"FROM documents, (SELECT unnest([0, 1, 2]) AS a))")


def _logits_sql() -> str:
    return (f"lg AS (SELECT doc_id AS id, ((doc_id % 41) - 20) / {D(4)} AS logit, "
            f"CAST(toxic AS INTEGER) AS label FROM labels)")


# ---------------------------------------------------------------------------
# queries
# ---------------------------------------------------------------------------

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def bigint_counts(sql: str) -> str:
    """DuckDB's ``count_if`` is HUGEINT; Spark's is BIGINT. Cast every call."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while True:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            if depth == 0:
                break
            k += 1
        out.append(sql[i:j] + "CAST(" + sql[j:k + 1] + " AS BIGINT)")
        i = k + 1


def register(name: str, sql: str | None = None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = bigint_counts(sql)
        return fn
    return deco


# ---- B: projections and filters -------------------------------------------

@register("normalise_text", f"WITH {SQL_NULLS} SELECT id, {O.normalise('comment_text')} AS normalised FROM nsrc")
def q_normalise(spark, sf):
    return _with_nulls(spark, sf).select("id", normalise_text("comment_text").alias("normalised"))


@register("clean_text", f"WITH {SQL_NULLS} SELECT id, coalesce({O.normalise('comment_text')}, '') AS cleaned FROM nsrc")
def q_clean(spark, sf):
    return _with_nulls(spark, sf).select("id", clean_text("comment_text").alias("cleaned"))


@register("drop_empty", f"WITH {SQL_NULLS}, c AS (SELECT id, coalesce({O.normalise('comment_text')}, '') AS comment_text FROM nsrc) "
                        "SELECT id, comment_text FROM c WHERE length(comment_text) > 0")
def q_drop_empty(spark, sf):
    return P.drop_empty(_with_nulls(spark, sf))


@register("eligible_examples", f"WITH {_training_sql()}, c AS (SELECT id, label, coalesce({O.normalise('comment_text')}, '') AS comment_text FROM training) "
                               "SELECT id, label FROM c WHERE label = 1 AND length(comment_text) > 50 "
                               "UNION ALL SELECT id, label FROM c WHERE label = 0 AND length(comment_text) > 50")
def q_eligible(spark, sf):
    t = _training(spark, sf).withColumn("comment_text", clean_text("comment_text"))
    return P.eligible(t, 1).unionByName(P.eligible(t, 0)).select("id", "label")


@register("fill_missing", f"WITH {_filled_sql()} SELECT id, {', '.join(sql_r9(c) + ' AS ' + c for c in NUMERIC)} FROM filled")
def q_fill(spark, sf):
    f = P.fill_missing(_comments(spark, sf))
    return f.select("id", *[r9(c).alias(c) for c in NUMERIC])


@register("label_v1", f"WITH {_filled_sql()} SELECT id, {_label_sql('v1')} AS race_bias FROM filled")
def q_label_v1(spark, sf):
    return P.derive_label(P.fill_missing(_comments(spark, sf)), "v1").select("id", "race_bias")


@register("label_v2", f"WITH {_filled_sql()} SELECT id, {_label_sql('v2')} AS race_bias FROM filled")
def q_label_v2(spark, sf):
    return P.derive_label(P.fill_missing(_comments(spark, sf)), "v2").select("id", "race_bias")


@register("training_projection", f"WITH {_training_sql()} SELECT id, comment_text, label FROM training")
def q_training(spark, sf):
    return _training(spark, sf)


@register("target_split", f"WITH {_comments_sql()} SELECT count(*) AS total, count_if(target > 0.5) AS toxic_n, "
                          "count_if(target <= 0.5) AS non_toxic_n FROM comments")
def q_target_split(spark, sf):
    return P.target_split(_comments(spark, sf))


@register("predict_threshold", f"WITH {_logits_sql()} SELECT id, {sql_r9(f'1.0::DOUBLE / (1.0::DOUBLE + exp(-logit))')} AS prob, "
                               f"CAST(1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)) > 0.5 AS INTEGER) AS pred FROM lg")
def q_predict(spark, sf):
    lg = T.labelled_logits(spark, sf)
    p = P.predict(lg)
    return p.select("id", r9("prob").alias("prob"), "pred")


# ---- C: joins ----------------------------------------------------------------

def _lexicon_values_sql() -> str:
    rows = ", ".join(f"({q(v)}, {q(n)}, {i}, {q(t)})" for v, n, _, _, i, t, _ in lexicon_table.rows(kinds=["term"]))
    return f"lex(version, name, ordinal, term) AS (VALUES {rows})"


@register("lexicon_matches", f"WITH {SQL_SRC}, {O.norm_cte()}, {_lexicon_values_sql()} "
                             "SELECT id, version, name AS lexicon, term FROM norm JOIN lex ON contains(lt, term)")
def q_lexicon_matches(spark, sf):
    return LX.lexicon_matches(_planted(spark, sf), lexicon_table.lexicon_df(spark))


_EDGED = "regexp_matches(lt, '(^|[^\\p{L}\\p{N}])' || regexp_escape(term) || '($|[^\\p{L}\\p{N}])')"


@register("lexicon_matches_words", f"WITH {SQL_SRC}, {O.norm_cte()}, {_lexicon_values_sql()} "
                                   ", h AS MATERIALIZED (SELECT id, lt, version, name, term FROM norm JOIN lex ON contains(lt, term)) "
                                   f"SELECT id, version, name AS lexicon, term FROM h WHERE {_EDGED}")
def q_lexicon_matches_words(spark, sf):
    """C1 between word boundaries: 'race' is not in 'embrace'."""
    return LX.lexicon_matches(_planted(spark, sf), lexicon_table.lexicon_df(spark), word_boundary=True)


def word_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """A lexicon that grows with the data: every word of the benchmark's items, each item a lexicon."""
    items = T.read_table(spark, sf, "benchmark")
    words = items.select(F.concat(F.lit("item"), F.col("item_id")).alias("name"), F.explode(F.split(F.lower("text"), "[^a-z\u00e0-\u00ff]+")).alias("term"))
    return words.where("term <> ''").distinct().withColumn("ordinal", F.lit(0))


@register("lexicon_matches_grams", f"WITH {SQL_SRC}, {O.norm_cte()}, words AS (SELECT DISTINCT 'item' || item_id AS lexicon, "
                                   "unnest(string_split_regex(lower(text), '[^a-z\u00e0-\u00ff]+')) AS term FROM benchmark), "
                                   "terms AS (SELECT DISTINCT term FROM words WHERE term <> ''), hits AS (SELECT id, term FROM norm JOIN terms ON contains(lt, term)) "
                                   "SELECT lexicon, term, count(*) AS n FROM hits JOIN words USING (term) GROUP BY lexicon, term")
def q_lexicon_matches_grams(spark, sf):
    """C1 by the inverted q-gram join, whatever the lexicon's size; texts per lexicon and term."""
    words = word_lexicon(spark, sf)
    hits = LX.gram_matches(_planted(spark, sf), words.select(F.lit("words").alias("name"), "term").distinct())
    n = hits.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return n.join(words, "term").select(F.col("name").alias("lexicon"), "term", "n")


LEXICONS = list(dict.fromkeys((v, n) for v, n, *_ in lexicon_table.rows(kinds=["term"])))


@register("term_counts", f"WITH {SQL_SRC}, {O.norm_cte()}, {_lexicon_values_sql()} SELECT id, "
                         + ", ".join(f"count(DISTINCT term) FILTER (version = {q(v)} AND name = {q(n)}) AS n_{v}_{n}" for v, n in LEXICONS)
                         + " FROM norm LEFT JOIN lex ON contains(lt, term) GROUP BY id")
def q_term_counts(spark, sf):
    d = LX.term_counts(_planted(spark, sf), lexicon_table.lexicon_df(spark))
    return d.select("id", *[F.col(f"n_{v}_{n}").cast("long").alias(f"n_{v}_{n}") for v, n in LEXICONS])


@register("attach_scores", f"WITH {_comments_sql()}, sc AS (SELECT doc_id AS id, {O.model_sql()} AS model_score FROM labels) "
                           f"SELECT c.id, {sql_r9('coalesce(sc.model_score, 0.0::DOUBLE)')} AS model_score FROM comments c LEFT JOIN sc ON c.id = sc.id")
def q_attach_scores(spark, sf):
    """Scores exist for the labelled documents only; the others get 0."""
    lab = T.read_table(spark, sf, "labels")
    sc = lab.select(F.col("doc_id").alias("id"), T.model_score(F.col("doc_id")).alias("model_score"))
    out = P.attach_scores(_comments(spark, sf).select("id"), sc)
    return out.select("id", r9("model_score").alias("model_score"))


ANN_OUT = ["toxic", "severe_toxic", "obscene", "ann_threat", "ann_insult", "identity_hate"]


@register("attach_annotations", f"WITH {_comments_sql()}, {_annotations_sql()}, m AS (SELECT comment_id, "
                                + ", ".join(f"avg({c}) AS {c}" for c in P.SCORE_COLUMNS) + " FROM ann GROUP BY comment_id) "
                                "SELECT c.id, " + ", ".join(
                                    f"{sql_r9('m.' + src)} AS {dst}" for src, dst in zip(P.SCORE_COLUMNS, ["toxic", "severe_toxic", "obscene", "ann_threat", "ann_insult", "identity_hate"]))
                                + " FROM comments c LEFT JOIN m ON c.id = m.comment_id")
def q_attach_annotations(spark, sf):
    means = P.annotator_means(T.annotations(spark, sf))
    out = P.attach_annotations(_comments(spark, sf).select("id", "threat", "insult"), means)
    return out.select("id", *[r9(c).alias(c) for c in ANN_OUT])


# ---- D: aggregations ----------------------------------------------------------

@register("annotator_means", f"WITH {_annotations_sql()} SELECT comment_id, "
                             + ", ".join(f"{sql_r9(f'avg({c})')} AS {c}" for c in P.SCORE_COLUMNS)
                             + " FROM ann GROUP BY comment_id")
def q_annotator_means(spark, sf):
    m = P.annotator_means(T.annotations(spark, sf))
    return m.select("comment_id", *[r9(c).alias(c) for c in P.SCORE_COLUMNS])


@register("label_distribution", f"WITH {_training_sql()} SELECT count(*) AS total, count_if(label = 1) AS positives, "
                                "count_if(label = 0) AS negatives FROM training")
def q_label_distribution(spark, sf):
    return AG.label_distribution(_training(spark, sf))


@register("class_weights", f"WITH {_training_sql()}, c AS (SELECT count(*) AS total, count_if(label = 0) AS n_negative, "
                           "count_if(label = 1) AS n_positive FROM training) SELECT total, n_negative, n_positive, "
                           f"{sql_r9('total::DOUBLE / (2 * n_negative)')} AS negative_weight, "
                           f"{sql_r9('total::DOUBLE / (2 * n_positive)')} AS positive_weight FROM c")
def q_class_weights(spark, sf):
    w = AG.class_weights(_training(spark, sf))
    return w.select("total", "n_negative", "n_positive", r9("negative_weight").alias("negative_weight"),
                    r9("positive_weight").alias("positive_weight"))


@register("pos_weight", f"SELECT {sql_r9('count_if(toxic = 0)::DOUBLE / count_if(toxic = 1)')} AS pos_weight FROM labels")
def q_pos_weight(spark, sf):
    lab = T.read_table(spark, sf, "labels").select(F.col("toxic").alias("label"))
    return AG.pos_weight(lab).select(r9("pos_weight").alias("pos_weight"))


def _metrics_sql(src: str) -> str:
    return (f"c AS (SELECT count_if(pred = 1 AND label = 1)::DOUBLE AS tp, count_if(pred = 1 AND label = 0)::DOUBLE AS fp, "
            f"count_if(pred = 0 AND label = 1)::DOUBLE AS fn FROM {src}), "
            f"m AS (SELECT *, tp / (tp + fp + 1e-10::DOUBLE) AS precision, tp / (tp + fn + 1e-10::DOUBLE) AS recall FROM c) "
            f"SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {sql_r9('precision')} AS precision, "
            f"{sql_r9('recall')} AS recall, {sql_r9('2.0::DOUBLE * (precision * recall) / (precision + recall + 1e-10::DOUBLE)')} AS f1 FROM m")


def _rounded_metrics(m: DataFrame) -> DataFrame:
    return m.select("tp", "fp", "fn", *[r9(c).alias(c) for c in ("precision", "recall", "f1")])


@register("binary_metrics", f"WITH {_logits_sql()}, p AS (SELECT CAST(1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)) > 0.5 AS INTEGER) AS pred, label FROM lg), "
                            + _metrics_sql("p"))
def q_binary_metrics(spark, sf):
    lg = T.labelled_logits(spark, sf)
    return _rounded_metrics(AG.binary_metrics(P.predict(lg)))


@register("focal_loss", f"WITH {_logits_sql()}, b AS (SELECT greatest(logit, 0.0::DOUBLE) - logit * label + ln(1.0::DOUBLE + exp(-abs(logit))) AS bce FROM lg) "
                        f"SELECT {sql_r9('avg(pow(1.0::DOUBLE - exp(-bce), 2.0::DOUBLE) * bce)')} AS focal_loss, count(*) AS n FROM b")
def q_focal(spark, sf):
    f = AG.focal_loss(T.labelled_logits(spark, sf))
    return f.select(r9("focal_loss").alias("focal_loss"), "n")


# ---- E: dedup, sampling, ordering ---------------------------------------------

@register("dedup_keep_first", f"WITH {_comments_sql()}, r AS (SELECT id, source_rank, comment_text, row_number() OVER "
                              "(PARTITION BY comment_text ORDER BY source_rank, id) AS rn FROM comments) "
                              "SELECT id, source_rank, comment_text FROM r WHERE rn = 1")
def q_dedup(spark, sf):
    return P.dedup_keep_first(_comments(spark, sf).select("id", "source_rank", "comment_text"))


@register("balanced_sample", f"WITH {_balanced_sql()} SELECT id, label FROM balanced")
def q_balanced(spark, sf):
    return _balanced(spark, sf).select("id", "label")


@register("class_examples", f"WITH {_balanced_sql()}, c AS (SELECT id, label, coalesce({O.normalise('comment_text')}, '') AS t FROM balanced), "
                            f"r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_key_sql()}, id) AS rn FROM c WHERE length(t) > 50) "
                            "SELECT id, label FROM r WHERE rn <= 5")
def q_class_examples(spark, sf):
    b = _balanced(spark, sf).withColumn("comment_text", clean_text("comment_text"))
    return S.class_examples(b, n=5).select("id", "label")


@register("class_examples_all", f"WITH {_training_sql()}, c AS (SELECT id, label, coalesce({O.normalise('comment_text')}, '') AS t FROM training), "
                                f"r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_key_sql()}, id) AS rn FROM c WHERE length(t) > 50) "
                                "SELECT id, label FROM r WHERE rn <= 5")
def q_class_examples_all(spark, sf):
    t = _training(spark, sf).withColumn("comment_text", clean_text("comment_text"))
    return S.class_examples(t, n=5).select("id", "label")


@register("stratified_split", f"WITH {_balanced_sql()}, r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {_key_sql()}, id) AS rn, "
                              "count(*) OVER (PARTITION BY label) AS n FROM balanced) "
                              "SELECT id, label, CASE WHEN rn <= ceil(n * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM r")
def q_split(spark, sf):
    return S.stratified_split(_balanced(spark, sf)).select("id", "label", "split")


@register("shuffle_rank", f"WITH {_balanced_sql()} SELECT id, CAST(row_number() OVER (ORDER BY {_key_sql()}, id) AS INTEGER) AS shuffle_rank FROM balanced")
def q_shuffle(spark, sf):
    return S.shuffle(_balanced(spark, sf)).select("id", F.col("shuffle_rank").cast("int"))


@register("stratified_split_all", f"WITH {_training_sql()}, r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {_key_sql()}, id) AS rn, "
                                  "count(*) OVER (PARTITION BY label) AS n FROM training) "
                                  "SELECT id, label, CASE WHEN rn <= ceil(n * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM r")
def q_split_all(spark, sf):
    return S.stratified_split(_training(spark, sf)).select("id", "label", "split")


@register("shuffle_rank_all", f"WITH {_training_sql()} SELECT id, CAST(row_number() OVER (ORDER BY {_key_sql()}, id) AS INTEGER) AS shuffle_rank FROM training")
def q_shuffle_all(spark, sf):
    return S.shuffle(_training(spark, sf)).select("id", F.col("shuffle_rank").cast("int"))


@register("sample_or_all", f"WITH {_training_sql()} SELECT id, label FROM training WHERE label = 0")
def q_sample_or_all(spark, sf):
    """With an empty class there is no balanced sample; every row stays."""
    return S.balanced_sample(_training(spark, sf).filter("label = 0"), cap=CAP).select("id", "label")


@register("debug_sample", f"WITH {_comments_sql()} SELECT id FROM comments ORDER BY {_key_sql()}, id LIMIT {DEBUG}")
def q_debug_sample(spark, sf):
    return S.debug_sample(_comments(spark, sf), n=DEBUG).select("id")


THRESHOLDS = [-2.0, -1.0, 0.0, 1.0, 2.0]


def _candidates(spark, sf) -> DataFrame:
    """One metrics row per decision threshold on the logit: train/val F1 and val focal loss."""
    lg = S.stratified_split(T.labelled_logits(spark, sf), exact=False)
    grid = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("ordinal"), F.lit(t).alias("thr"))
                               for i, t in enumerate(THRESHOLDS)]))
    g = lg.select("*", grid.alias("c")).select("*", (F.col("logit") > F.col("c.thr")).cast("int").alias("pred"))
    y, p, val = F.col("label"), F.col("pred"), F.col("split") == "val"

    def cnt(cond):
        return F.count_if(cond).cast("double")
    agg = g.groupBy(F.col("c.ordinal").alias("ordinal"), F.col("c.thr").alias("thr")).agg(
        cnt((p == 1) & (y == 1) & ~val).alias("ttp"), cnt((p == 1) & (y == 0) & ~val).alias("tfp"),
        cnt((p == 0) & (y == 1) & ~val).alias("tfn"),
        cnt((p == 1) & (y == 1) & val).alias("vtp"), cnt((p == 1) & (y == 0) & val).alias("vfp"),
        cnt((p == 0) & (y == 1) & val).alias("vfn"),
        F.avg(F.when(val, AG.focal_term(F.col("logit") - F.col("c.thr"), y.cast("double")))).alias("val_loss"),
    )

    def f1(tp, fp, fn):
        pr = F.col(tp) / (F.col(tp) + F.col(fp) + F.lit(AG.EPS))
        rc = F.col(tp) / (F.col(tp) + F.col(fn) + F.lit(AG.EPS))
        return F.lit(2.0) * (pr * rc) / (pr + rc + F.lit(AG.EPS))
    return agg.select("ordinal", F.concat(F.lit("threshold="), F.col("thr").cast("string")).alias("params"),
                      r9(f1("ttp", "tfp", "tfn")).alias("train_f1"), r9(f1("vtp", "vfp", "vfn")).alias("val_f1"),
                      r9("val_loss").alias("val_loss"))


def _candidates_sql() -> str:
    grid = ", ".join(f"({i + 1}, {D(t)}, {q('threshold=' + repr(float(t)))})" for i, t in enumerate(THRESHOLDS))
    u = "CAST(('x' || substr(" + _key_sql() + ", 1, 8))::BIT::UBIGINT AS DOUBLE)"
    u = f"(CAST(('0x' || substr({_key_sql()}, 1, 8)) AS UBIGINT)::DOUBLE / {D(2 ** 32)})"
    return f"""{_logits_sql()}, s AS (SELECT *, {u} < 0.2 AS val FROM lg),
grid(ordinal, thr, params) AS (VALUES {grid}),
g AS (SELECT s.*, grid.*, CAST(logit > thr AS INTEGER) AS pred FROM s, grid),
a AS (SELECT ordinal, params,
  count_if(pred = 1 AND label = 1 AND NOT val)::DOUBLE AS ttp, count_if(pred = 1 AND label = 0 AND NOT val)::DOUBLE AS tfp,
  count_if(pred = 0 AND label = 1 AND NOT val)::DOUBLE AS tfn, count_if(pred = 1 AND label = 1 AND val)::DOUBLE AS vtp,
  count_if(pred = 1 AND label = 0 AND val)::DOUBLE AS vfp, count_if(pred = 0 AND label = 1 AND val)::DOUBLE AS vfn,
  avg(CASE WHEN val THEN pow(1.0::DOUBLE - exp(-(greatest(logit - thr, 0.0::DOUBLE) - (logit - thr) * label + ln(1.0::DOUBLE + exp(-abs(logit - thr))))), 2.0::DOUBLE)
      * (greatest(logit - thr, 0.0::DOUBLE) - (logit - thr) * label + ln(1.0::DOUBLE + exp(-abs(logit - thr)))) END) AS val_loss
 FROM g GROUP BY ordinal, params),
m AS (SELECT ordinal, params,
  2.0::DOUBLE * ((ttp / (ttp + tfp + 1e-10::DOUBLE)) * (ttp / (ttp + tfn + 1e-10::DOUBLE))) / ((ttp / (ttp + tfp + 1e-10::DOUBLE)) + (ttp / (ttp + tfn + 1e-10::DOUBLE)) + 1e-10::DOUBLE) AS train_f1,
  2.0::DOUBLE * ((vtp / (vtp + vfp + 1e-10::DOUBLE)) * (vtp / (vtp + vfn + 1e-10::DOUBLE))) / ((vtp / (vtp + vfp + 1e-10::DOUBLE)) + (vtp / (vtp + vfn + 1e-10::DOUBLE)) + 1e-10::DOUBLE) AS val_f1,
  val_loss FROM a),
cand AS (SELECT ordinal, params, round(train_f1, 9) AS train_f1, round(val_f1, 9) AS val_f1, round(val_loss, 9) AS val_loss FROM m)"""


@register("best_candidate", f"WITH {_candidates_sql()} SELECT * FROM cand WHERE val_f1 > 0 ORDER BY val_f1 DESC, ordinal LIMIT 1")
def q_best_candidate(spark, sf):
    return S.best_candidate(_candidates(spark, sf))


# ---- F: set operations ----------------------------------------------------------

UNION_OUT = ["id", "conv_id", "turn", "item_id", "comment_id"]


@register("union_sources", f"""WITH {_comments_sql()}, {_annotations_sql()},
m AS (SELECT comment_id, avg(toxic) AS toxic FROM ann GROUP BY comment_id),
u AS (SELECT 0 AS source_rank, id, comment_text, target FROM comments
      UNION ALL BY NAME SELECT 1 AS source_rank, conv_id, turn, text AS comment_text FROM conversations
      UNION ALL BY NAME SELECT 2 AS source_rank, item_id, text AS comment_text FROM benchmark
      UNION ALL BY NAME SELECT 3 AS source_rank, comment_id, toxic FROM m)
SELECT source_rank, {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in UNION_OUT)}, comment_text,
       {sql_r9('target')} AS target, {sql_r9('toxic')} AS toxic FROM u""")
def q_union(spark, sf):
    """four sources with different columns stacked by name (missing = null)."""
    s0 = _comments(spark, sf).select("id", "comment_text", "target")
    s1 = T.read_table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("comment_text"))
    s2 = T.read_table(spark, sf, "benchmark").select("item_id", F.col("text").alias("comment_text"))
    s3 = P.annotator_means(T.annotations(spark, sf), scores=["toxic"])
    u = P.union_sources([s0, s1, s2, s3])
    # ids as text: nullable integers come back as floats in some client libraries
    return u.select(F.col("source_rank").cast("int").alias("source_rank"),
                    *[F.col(c).cast("string").alias(c) for c in UNION_OUT], "comment_text",
                    r9("target").alias("target"), r9("toxic").alias("toxic"))


# ---- G: text, lexicon and feature operators --------------------------------------

def _v2(spark, sf, raw=False):
    return A.v2_flags(_planted(spark, sf), "comment_text", raw=raw)


def _feat_sql(select: str) -> str:
    return f"WITH {SQL_SRC}, {O.norm_cte()} SELECT id, {select} FROM norm"


V2_FLAT = {"explicit": L.EXPLICIT_RACIAL_TERMS, "coded": L.V2_CODED_RACIAL_TERMS,
           "stereotype": L.V2_RACIAL_STEREOTYPES, "economic": L.V2_ECONOMIC_BIAS_TERMS}


@register("term_count", _feat_sql(", ".join(f"{O.count(v)} AS n_{k}" for k, v in V2_FLAT.items())))
def q_term_count(spark, sf):
    d, h = _v2(spark, sf)
    return d.select("id", *[h.count(v).alias(f"n_{k}") for k, v in V2_FLAT.items()])


@register("any_term", _feat_sql(", ".join(f"{O.any_(v)} AS any_{k}" for k, v in V2_FLAT.items())))
def q_any_term(spark, sf):
    d, h = _v2(spark, sf)
    return d.select("id", *[h.any(v).alias(f"any_{k}") for k, v in V2_FLAT.items()])


def _matched_sql(terms) -> str:
    return ("array_to_string(list_filter([" + ", ".join(f"CASE WHEN {O.hit(t)} THEN {q(t)} END" for t in terms)
            + "], lambda x: x IS NOT NULL), '|')")


@register("matched_terms", _feat_sql(", ".join(f"{_matched_sql(v)} AS matched_{k}" for k, v in V2_FLAT.items())))
def q_matched(spark, sf):
    d, h = _v2(spark, sf)
    return d.select("id", *[joined(h.matched(v)).alias(f"matched_{k}") for k, v in V2_FLAT.items()])


@register("lexicon_score_v2", _feat_sql(sql_r9(f"({O.count(L.EXPLICIT_RACIAL_TERMS)} * {D(0.4)} + {O.count(L.V2_CODED_RACIAL_TERMS)} * {D(0.4)}) "
                                                f"+ {O.count(L.V2_RACIAL_STEREOTYPES)} * {D(0.4)}") + " AS lexicon_score"))
def q_lex_v2(spark, sf):
    d, h = _v2(spark, sf)
    return d.select("id", r9(rules_v2.lexicon_score(h)).alias("lexicon_score"))


@register("lexicon_score_v1", _feat_sql(sql_r9(f"({O.count(L.EXPLICIT_RACIAL_TERMS)} * {D(0.35)} + {O.count(L.V1_CODED_RACIAL_TERMS)} * {D(0.30)}) "
                                                f"+ {O.count(L.V1_RACIAL_STEREOTYPES)} * {D(0.35)}") + " AS lexicon_score"))
def q_lex_v1(spark, sf):
    d, h = A.v1_flags(_planted(spark, sf), "comment_text")
    return d.select("id", r9(rules_v1.lexicon_score(h)).alias("lexicon_score"))


def _coverage_query(name: str, groups: dict, out_names: list[str]):
    sql = _feat_sql(", ".join(f"{sql_r9(O.coverage(g))} AS {n}" for n, g in zip(out_names, groups.values())))

    def fn(spark, sf):
        d, h = _v2(spark, sf)
        return d.select("id", *[r9(rules_v2.category_coverage(h, g)).alias(n) for n, g in zip(out_names, groups.values())])
    register(name, sql)(fn)


_coverage_query("intent_scores", L.V2_INTENT_MARKERS, L.V2_INTENT_NAMES)
_coverage_query("framing_scores", L.V2_FRAMING_MARKERS, list(L.V2_FRAMING_MARKERS))
_coverage_query("evidence_scores", L.V2_EVIDENCE_MARKERS, list(L.V2_EVIDENCE_MARKERS))
_coverage_query("structure_scores", L.V2_STATEMENT_STRUCTURES, list(L.V2_STATEMENT_STRUCTURES))


@register("relation_scores", _feat_sql(", ".join(f"{sql_r9(e)} AS {k}" for k, e in O.relation_exprs().items())))
def q_relations(spark, sf):
    d, h = _v2(spark, sf)
    return d.select("id", *[r9(c).alias(k) for k, c in rules_v2.relation_scores(h).items()])


def _few(spark, sf, lex, *names: str):
    """The planted texts with the bits of a few lists only."""
    return A.term_hits(_planted(spark, sf), "comment_text", [t for n in names for t in lex.terms[n]])


def _single_feature(name: str, spark_fn, sql_key: str, rounded: bool = True, lists: tuple = ()):
    expr = O.v2_feature_exprs()[sql_key]
    sql = _feat_sql(f"{sql_r9(expr) if rounded else expr} AS {name}")

    def fn(spark, sf):
        d, h = _few(spark, sf, V2, *lists) if lists else _v2(spark, sf)
        c = spark_fn(h)
        return d.select("id", (r9(c) if rounded else c).alias(name))
    register(name, sql)(fn)


_single_feature("economic_contrast", rules_v2.economic_contrast, "econ")
_single_feature("positive_research", rules_v2.positive_research, "posres")
_single_feature("legitimate_systemic", rules_v2.legitimate_systemic, "legit")
_single_feature("historical_education", rules_v2.historical_education, "hist", lists=("historical", "educational", "critical"))
_single_feature("systemic_discussion", rules_v2.systemic_discussion, "sys", lists=("systemic", "solution", "factual"))
_single_feature("cultural_bias", rules_v2.cultural_bias, "cult")
_single_feature("evidence_quality", rules_v2.evidence_quality, "eq")
_single_feature("strong_indicator", rules_v2.strong_indicator, "strong", rounded=False, lists=("strong",))


@register("research_direction", _feat_sql(f"({O.any_(L.V2_POSITIVE_RESEARCH_TERMS)} AND NOT {O.any_(L.V2_NEGATIVE_RESEARCH_TERMS)}) AS research_direction"))
def q_research_direction(spark, sf):
    d, h = _few(spark, sf, V2, "positive_finding", "negative_finding")
    return d.select("id", rules_v2.research_direction(h).alias("research_direction"))


def _v1_sql(select: str) -> str:
    return f"WITH {O.v1_score_ctes()} SELECT id, {select} FROM v1"


def _v1(spark, sf):
    d, h = A.v1_flags(_planted(spark, sf), "comment_text")
    return d, h


def _pair_tags_sql() -> str:
    items = []
    for i, (base, ctx) in enumerate(L.V1_CONTEXTUAL_PAIRS):
        n = "(" + " + ".join(f"CAST(list_contains(w{i}, {q(c)}) AS INTEGER)" for c in ctx) + ")"
        first = "CASE " + " ".join(f"WHEN list_contains(w{i}, {q(c)}) THEN {q(c)}" for c in ctx) + " END"
        items.append(f"CASE WHEN {n} > 0 THEN {q(base + '-')} || {first} END")
    return "array_to_string(list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL), '|')"


@register("token_context", f"WITH {SQL_SRC}, {O.norm_cte()}, {O.v1_window_ctes()} SELECT id, "
                           f"{sql_r9(O.v1_context_exprs()[0])} AS token_context_score, {_pair_tags_sql()} AS pair_tags FROM win")
def q_token_context(spark, sf):
    d, _ = _v1(spark, sf)
    score, tags = rules_v1.token_context()
    return d.select("id", r9(score).alias("token_context_score"),
                    joined(F.array_compact(F.array(*tags))).alias("pair_tags"))


@register("group_list", _feat_sql(f"{O.count(L.EXPLICIT_RACIAL_TERMS)} >= 3 AS group_list"))
def q_group_list(spark, sf):
    d, h = _few(spark, sf, V1, "explicit")
    return d.select("id", rules_v1.group_list(h).alias("group_list"))


@register("war_context", _feat_sql(f"({O.any_(L.V1_WAR_TERMS)} AND {O.count(L.EXPLICIT_RACIAL_TERMS)} > 0) AS war_context"))
def q_war_context(spark, sf):
    d, h = _few(spark, sf, V1, "explicit", "war")
    return d.select("id", rules_v1.war_context(h).alias("war_context"))


@register("context_score_v1", _v1_sql(f"{sql_r9('ctx')} AS context_score, array_to_string(tags, '|') AS context_tags"))
def q_context_v1(spark, sf):
    d, h = _v1(spark, sf)
    s, tags = rules_v1.context_score(h)
    return d.select("id", r9(s).alias("context_score"), joined(tags).alias("context_tags"))


@register("truncated_tokens", f"WITH {SQL_SRC}, t AS (SELECT id, {O.normalise('comment_text')} AS n FROM src), "
                              "w AS (SELECT id, CASE WHEN n = '' THEN []::VARCHAR[] ELSE string_split(n, ' ')[1:256] END AS toks FROM t) "
                              "SELECT id, CAST(len(toks) AS INTEGER) AS n_tokens, array_to_string(toks, ' ') AS tokens FROM w")
def q_truncated(spark, sf):
    t = _planted(spark, sf).select("id", truncated_tokens("comment_text").alias("toks"))
    return t.select("id", F.size("toks").alias("n_tokens"), F.array_join("toks", " ").alias("tokens"))


# ---- H: scores, decisions, reports -------------------------------------------------

def _score_out(df: DataFrame) -> DataFrame:
    return df.select("id", r9("bias_score").alias("bias_score"), "is_biased")


# A user's own lists: rows added to and taken from the published table, and the same for the statement
OWN_ROWS = [
    ("v2", "coded", "term", None, 1000, "parking", None),
    ("v2", "strong", "term", None, 1000, "bus runs", None),
    ("v2", "economic_contrast", "pair", "library", 1000, "weekdays", None),
    ("v2", "blame", "list", None, 1000, "rents", None),
    ("v2", "evidence.high_quality", "category", "verification", 1000, "census", None),
    ("v1", "coded", "term", None, 1000, "parking", None),
    ("v1", "war", "list", None, 1000, "bus", None),
    ("v1", "context", "pair", "library", 1000, "opens", None),
]


def own_lexicon(spark: SparkSession) -> DataFrame:
    """The published table without the coded term 'urban', with OWN_ROWS."""
    table = lexicon_table.rule_df(spark).where("NOT (name = 'coded' AND term = 'urban')")
    return table.unionByName(spark.createDataFrame(OWN_ROWS, lexicon_table.SCHEMA))


def _own_lists():
    own = types.SimpleNamespace(**vars(L))
    for name in ("V1_CODED_RACIAL_TERMS", "V2_CODED_RACIAL_TERMS"):
        setattr(own, name, [t for t in getattr(L, name) if t != "urban"] + ["parking"])
    own.V2_STRONG_INDICATORS = L.V2_STRONG_INDICATORS + ["bus runs"]
    own.V2_ECONOMIC_CONTRAST_PAIRS = L.V2_ECONOMIC_CONTRAST_PAIRS + [("library", ["weekdays"])]
    own.V2_BLAME_TERMS = L.V2_BLAME_TERMS + ["rents"]
    high = L.V2_EVIDENCE_MARKERS["high_quality"]
    own.V2_EVIDENCE_MARKERS = {**L.V2_EVIDENCE_MARKERS, "high_quality": {**high, "verification": high["verification"] + ["census"]}}
    own.V1_WAR_TERMS = L.V1_WAR_TERMS + ["bus"]
    own.V1_CONTEXTUAL_PAIRS = L.V1_CONTEXTUAL_PAIRS + [("library", ["opens"])]
    return own


@register("score_v2_lexicon", O.score_v2_sql(_own_lists()))
def q_score_v2_lexicon(spark, sf):
    return _score_out(A.score_v2(_planted(spark, sf), lexicon=own_lexicon(spark)))


@register("score_v1_lexicon", f"WITH {O.v1_score_ctes(L=_own_lists())} SELECT id, {sql_r9('score')} AS bias_score, score > {D(L.BIAS_THRESHOLD)} AS is_biased FROM v1")
def q_score_v1_lexicon(spark, sf):
    return _score_out(A.score_v1(_planted(spark, sf), lexicon=own_lexicon(spark)))


@register("score_v2", f"WITH {O.v2_analysis_ctes()} SELECT id, {sql_r9('score')} AS bias_score, score > {D(L.BIAS_THRESHOLD)} AS is_biased FROM v2")
def q_score_v2(spark, sf):
    return _score_out(A.score_v2(_planted(spark, sf)))


@register("score_v1", f"WITH {O.v1_score_ctes()} SELECT id, {sql_r9('score')} AS bias_score, score > {D(L.BIAS_THRESHOLD)} AS is_biased FROM v1")
def q_score_v1(spark, sf):
    return _score_out(A.score_v1(_planted(spark, sf)))


def _analysis(spark, sf, version="v2"):
    return A.analyze(_planted(spark, sf), version=version)


@register("category_scores", f"WITH {O.v2_analysis_ctes()} SELECT id, {sql_r9('score')} AS cat_race, 0.0::DOUBLE AS cat_gender, "
                             "0.0::DOUBLE AS cat_religion, 0.0::DOUBLE AS cat_sexual_orientation FROM v2")
def q_category_scores(spark, sf):
    a = _analysis(spark, sf)
    m = F.col("category_scores")
    return a.select("id", *[r9(m[c]).alias(f"cat_{c}") for c in L.CATEGORY_ORDER])


@register("confidence_band", f"WITH {O.v2_analysis_ctes()} SELECT id, {O.band('score')} AS band FROM v2")
def q_band(spark, sf):
    return _analysis(spark, sf).select("id", report.confidence_band(F.col("confidence")).alias("band"))


@register("pattern_tags_v2", f"WITH {O.v2_analysis_ctes()} SELECT id, array_to_string(tags, '|') AS pattern_tags FROM v2t")
def q_tags_v2(spark, sf):
    return _analysis(spark, sf).select("id", joined(F.col("pattern_tags")).alias("pattern_tags"))


@register("pattern_tags_v1", f"WITH {O.v1_score_ctes()} SELECT id, array_to_string({O.v1_pattern_tags_expr()}, '|') AS pattern_tags FROM v1")
def q_tags_v1(spark, sf):
    return _analysis(spark, sf, "v1").select("id", joined(F.col("pattern_tags")).alias("pattern_tags"))


@register("explain_v2", f"WITH {O.v2_analysis_ctes()} SELECT id, {O.explanation_sql('score', 'tags', O.v2_middle())} AS explanation FROM v2t")
def q_explain_v2(spark, sf):
    return _analysis(spark, sf).select("id", "explanation")


@register("explain_v1", f"WITH {O.v1_score_ctes()}, v1t AS (SELECT *, {O.v1_pattern_tags_expr()} AS ptags FROM v1) "
                        f"SELECT id, {O.explanation_sql('score', 'ptags')} AS explanation FROM v1t")
def q_explain_v1(spark, sf):
    return _analysis(spark, sf, "v1").select("id", "explanation")


@register("suggest", f"WITH {O.v2_analysis_ctes()} SELECT id, CASE WHEN score > {D(L.BIAS_THRESHOLD)} THEN {q(L.SUGGESTIONS['race'])} END AS alternative FROM v2")
def q_suggest(spark, sf):
    return _analysis(spark, sf).select("id", "alternative")


ANALYZE_SQL = (f"WITH {O.v2_analysis_ctes()} SELECT id, score > {D(L.BIAS_THRESHOLD)} AS is_biased, {sql_r9('score')} AS confidence, "
               f"{sql_r9('score')} AS cat_race, 0.0::DOUBLE AS cat_gender, 0.0::DOUBLE AS cat_religion, 0.0::DOUBLE AS cat_sexual_orientation, "
               f"{O.explanation_sql('score', 'tags', O.v2_middle())} AS explanation, "
               f"CASE WHEN score > {D(L.BIAS_THRESHOLD)} THEN {q(L.SUGGESTIONS['race'])} END AS alternative FROM v2t")


def flat_analysis(a: DataFrame) -> DataFrame:
    m = F.col("category_scores")
    return a.select("id", "is_biased", r9("confidence").alias("confidence"),
                    *[r9(m[c]).alias(f"cat_{c}") for c in L.CATEGORY_ORDER], "explanation", "alternative")


@register("analyze", ANALYZE_SQL)
def q_analyze(spark, sf):
    return flat_analysis(_analysis(spark, sf))


@register("evaluate_rows", f"WITH {O.v2_analysis_ctes()} SELECT v2t.id, CAST(l.toxic AS INTEGER) AS label, CAST(score > {D(L.BIAS_THRESHOLD)} AS INTEGER) AS pred, "
                           f"CAST(score > {D(L.BIAS_THRESHOLD)} AS INTEGER) = CAST(l.toxic AS INTEGER) AS correct, {sql_r9('score')} AS confidence, "
                           f"{O.explanation_sql('score', 'tags', O.v2_middle())} AS explanation FROM v2t JOIN labels l ON v2t.id = l.doc_id")
def q_evaluate_rows(spark, sf):
    lab = T.read_table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    r = EV.evaluate_rows(_analysis(spark, sf), lab)
    return r.select("id", "label", "pred", "correct", r9("confidence").alias("confidence"), "explanation")


@register("evaluate", f"WITH {O.v2_analysis_ctes()}, p AS (SELECT CAST(score > {D(L.BIAS_THRESHOLD)} AS INTEGER) AS pred, "
                      "CAST(l.toxic AS INTEGER) AS label FROM v2 JOIN labels l ON v2.id = l.doc_id), " + _metrics_sql("p"))
def q_evaluate(spark, sf):
    lab = T.read_table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    return _rounded_metrics(EV.evaluate(_analysis(spark, sf), lab))


@register("domain_report", f"WITH {O.v2_analysis_ctes()} SELECT d.source AS domain, count(*) AS n, count_if(score > {D(L.BIAS_THRESHOLD)}) AS flagged, "
                           f"{sql_r9('avg(score)')} AS mean_confidence FROM v2 JOIN documents d ON v2.id = d.doc_id GROUP BY d.source")
def q_domain_report(spark, sf):
    docs = T.read_table(spark, sf, "documents")
    src = docs.select(F.col("doc_id").alias("id"), planted_text_col(docs).alias("comment_text"),
                      T.model_score(F.col("doc_id")).alias("model_score"), F.col("source").alias("domain"))
    rep = AG.domain_report(A.analyze(src))
    return rep.select("domain", "n", "flagged", r9("mean_confidence").alias("mean_confidence"))


def planted_text_col(docs: DataFrame) -> Column:
    return T.planted_text(F.col("doc_id"), F.col("text"))


@register("pair_margin", f"WITH {O.v2_analysis_ctes()} SELECT id // 2 AS pair, "
                         f"{sql_r9('sum(CASE WHEN id % 2 = 1 THEN score ELSE -score END)')} AS margin, count(*) AS members FROM v2 GROUP BY id // 2")
def q_pair_margin(spark, sf):
    a = _analysis(spark, sf).select("id", "confidence")
    pm = EV.pair_margin(a.select((F.col("id") / 2).cast("long").alias("pair"),
                              (F.col("id") % 2 == 1).alias("is_biased_member"), "confidence"))
    return pm.select("pair", r9("margin").alias("margin"), "members")


# Examples as the published fixture numbers and tags them: 100 an edition, two a domain
def _examples(spark, sf) -> DataFrame:
    """id, edition, number (1 to 100), tag and the analysis of every planted document."""
    i = F.col("id")
    kind = F.concat(F.lit(" - Kind "), (i % 3).cast("string"), F.lit(" - x"))
    tag = F.concat(F.lit("Domain "), F.floor(i % 100 / 2).cast("string"), F.when(i % 7 == 3, F.lit("")).otherwise(kind))
    return _analysis(spark, sf).select("id", F.floor(i / 100).alias("edition"), (i % 100 + 1).alias("number"), tag.alias("tag"), "is_biased", "confidence")


_NUMBER = "(id % 100 + 1)"
SQL_EXAMPLES = (f"WITH {O.v2_analysis_ctes()}, e AS (SELECT id, id // 100 AS edition, 'Domain ' || (id % 100 // 2) AS domain, "
                "CASE WHEN id % 7 <> 3 THEN 'Kind ' || (id % 3) || ' - x' END AS kind, score, "
                f"CAST(score > {D(L.BIAS_THRESHOLD)} AS INTEGER) AS pred, "
                f"CAST({_NUMBER} IN (2, 4) OR ({_NUMBER} % 2 = 1 AND {_NUMBER} >= 5) AS INTEGER) AS label FROM v2)")


@register("domain_kind_report", f"{SQL_EXAMPLES} SELECT domain, kind, count(*) AS n, CAST(sum(pred) AS BIGINT) AS flagged, "
                                f"{sql_r9('avg(score)')} AS mean_confidence FROM e GROUP BY domain, kind")
def q_domain_kind_report(spark, sf):
    """D8 by the two parts of the tag."""
    rep = AG.domain_report(EV.split_tag(_examples(spark, sf)), "domain", "kind")
    return rep.select("domain", "kind", "n", "flagged", r9("mean_confidence").alias("mean_confidence"))


@register("evaluate_gold", f"{SQL_EXAMPLES}, " + _metrics_sql("e"))
def q_evaluate_gold(spark, sf):
    """H10 against the fixture's true labels."""
    e = _examples(spark, sf)
    return _rounded_metrics(EV.evaluate(e, e.select("id", EV.gold_label("number").alias("label"))))


@register("domain_margin", f"{SQL_EXAMPLES} SELECT edition, domain, {sql_r9('sum(CASE WHEN label = 1 THEN score ELSE -score END)')} AS margin, "
                           "count(*) AS members FROM e GROUP BY edition, domain")
def q_domain_margin(spark, sf):
    """Per domain the biased text's confidence minus the control's."""
    e = EV.split_tag(_examples(spark, sf)).withColumn("is_biased_member", EV.gold_label("number") == 1)
    pm = EV.pair_margin(e.withColumn("pair", F.struct("edition", "domain")))
    return pm.select("pair.edition", "pair.domain", r9("margin").alias("margin"), "members")


# ---- what of the classifier, the guards and the scorers doesn't hang on a fit ----

class LengthScorer:
    """Stands for an external model: a probability from the text's length."""

    def score(self, texts):
        return texts.str.len() % 101 / 100.0


def _length_score_sql(text: str) -> str:
    return f"((length(coalesce({O.normalise(text)}, '')) % 101) / {D(100.0)})"


@register("external_scores", f"WITH {SQL_NULLS} SELECT id, {sql_r9(_length_score_sql('comment_text'))} AS model_score FROM nsrc")
def q_external_scores(spark, sf):
    from ..operators import model as M
    return M.external_scores(_with_nulls(spark, sf), LengthScorer).select("id", r9("model_score").alias("model_score"))


@register("score_external", f"WITH {SQL_SRC.replace(O.model_sql(), _length_score_sql(O.planted_sql()))}, {O.norm_cte()}, {O.v2_feat_cte()}, {O.v2_chain_ctes()} "
                            f"SELECT id, {sql_r9('score')} AS bias_score, score > {D(L.BIAS_THRESHOLD)} AS is_biased FROM v2")
def q_score_external(spark, sf):
    """I1 into H2: the external scorer's column in the rule chain."""
    from ..operators import model as M
    return _score_out(A.score_v2(M.external_scores(_planted(spark, sf).select("id", "comment_text"), LengthScorer)))


def _all_labelled(spark, sf) -> DataFrame:
    docs = T.read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("comment_text"))
    return docs.join(T.read_table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label")), "id")


SQL_LABELLED = "d AS (SELECT CAST(toxic AS INTEGER) AS label FROM documents JOIN labels USING (doc_id))"


@register("empty_class_guard", f"WITH {_training_sql()} SELECT count_if(label = 0) AS negatives, count_if(label = 1) AS positives FROM training")
def q_empty_class_guard(spark, sf):
    """The counts that the guard lets pass."""
    negatives, positives = AG.empty_class_guard(_training(spark, sf))
    return spark.range(1).select(F.lit(negatives).cast("long").alias("negatives"), F.lit(positives).cast("long").alias("positives"))


@register("require_columns", f"WITH {_comments_sql()} SELECT 'Missing required columns: [''white'', ''latino'']' AS missing, count(*) AS n FROM comments")
def q_require_columns(spark, sf):
    """What it says of a table without two of the columns, and the rows of one that has all."""
    c = _comments(spark, sf)
    missing = ""
    try:
        P.require_columns(c.drop("white", "latino"))
    except ValueError as e:
        missing = str(e)
    return P.require_columns(c).agg(F.count(F.lit(1)).alias("n")).select(F.lit(missing).alias("missing"), "n")


@register("classifier_weights", f"WITH {SQL_LABELLED} SELECT label, count(*) AS n, {sql_r9('(SELECT count(*) FROM d)::DOUBLE / (2 * count(*))')} AS weight FROM d GROUP BY label")
def q_classifier_weights(spark, sf):
    """The weights that the fit is given."""
    from ..operators import model as M
    w = M.with_class_weights(_all_labelled(spark, sf))
    return w.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), R9).alias("weight"))


@register("validate_counts", f"WITH {SQL_LABELLED} SELECT count(*) AS n, count_if(label = 1) AS positives, count_if(label = 0) AS negatives FROM d")
def q_validate_counts(spark, sf):
    """What of the metrics is the same for every model: the rows and those of each class."""
    from ..operators import model as M
    d = _all_labelled(spark, sf)
    v = M.validate(M.train_classifier(d, max_iter=5), d)
    hits = F.col("tp") + F.col("fn")
    return v.select("n", hits.cast("long").alias("positives"), (F.col("n") - hits).cast("long").alias("negatives"))


@register("candidate_order", "SELECT 1 AS ordinal, 'reg_param=0.1,max_iter=3' AS params, count(*) AS n FROM labels JOIN documents USING (doc_id) "
                             "UNION ALL SELECT 2, 'reg_param=0.01,max_iter=3', count(*) FROM labels JOIN documents USING (doc_id)")
def q_candidate_order(spark, sf):
    """I4: candidates in the order of the grid, and the labelled rows they were fitted on."""
    from ..operators import model as M
    d = _all_labelled(spark, sf)
    cand, _ = M.select_model(d, d, [{"reg_param": 0.1, "max_iter": 3}, {"reg_param": 0.01, "max_iter": 3}])
    rows = d.agg(F.count(F.lit(1)).alias("n")).select("n", F.explode(F.array(F.lit(1), F.lit(2))).alias("ordinal"))
    return cand.select("ordinal", "params").join(rows, "ordinal")


@register("model_save_load", "SELECT count(*) AS n, count(*) AS same, count(*) AS within FROM documents")
def q_model_save_load(spark, sf):
    """Scores of a model before it is saved and after it is loaded."""
    from ..operators import model as M
    m = M.train_classifier(_all_labelled(spark, sf), max_iter=5)
    path = _folder(spark, "model")
    M.save_model(m, path)
    docs = _planted(spark, sf).select("id", "comment_text")
    before = M.model_scores(docs, m, out="before")
    after = M.model_scores(docs, M.load_model(path), out="after").select("id", "after")
    both = before.join(after, "id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") == F.col("after")).alias("same"), F.count_if(F.col("after").between(0, 1)).alias("within"))


# ---- I, J: classifier and stream (rows-only: no SQL equivalent) -----------------

def _labelled_docs(spark, sf) -> DataFrame:
    """Documents with a label (``labels.toxic``), split 80/20 by hash bucket."""
    docs = T.read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("comment_text"))
    lab = T.read_table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label"))
    return S.stratified_split(docs.join(lab, "id"), exact=False)


@register("train_classifier")
def q_train_classifier(spark, sf):
    from ..operators import model as M
    d = _labelled_docs(spark, sf)
    train = d.filter(F.col("split") == "train")
    return M.validate(M.train_classifier(train), train)


@register("validate_classifier")
def q_validate_classifier(spark, sf):
    from ..operators import model as M
    d = _labelled_docs(spark, sf)
    m = M.train_classifier(d.filter(F.col("split") == "train"))
    return M.validate(m, d.filter(F.col("split") == "val"))


@register("select_model")
def q_select_model(spark, sf):
    from ..operators import model as M
    d = _labelled_docs(spark, sf)
    cand, _ = M.select_model(d.filter(F.col("split") == "train"), d.filter(F.col("split") == "val"))
    chosen = M.best(cand).select("ordinal", F.lit(True).alias("selected"))
    return cand.join(chosen, "ordinal", "left").fillna(False, subset=["selected"])


@register("model_scores")
def q_model_scores(spark, sf):
    from ..operators import model as M
    d = _labelled_docs(spark, sf)
    m = M.train_classifier(d.filter(F.col("split") == "train"))
    return M.model_scores(_planted(spark, sf).select("id", "comment_text"), m).select("id", "model_score")


@register("score_stream", ANALYZE_SQL)
def q_score_stream(spark, sf):
    """The documents table read as a file stream, analysed, appended to Parquet."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..streaming.score_stream import score_stream, start_parquet_stream, stream_path
    docs = T.read_table(spark, sf, "documents")
    sink = f"{ensure_checkpoint_dir(spark).rstrip('/')}/score-stream-{uuid.uuid4().hex}"

    def prep(s):
        return s.select(F.col("doc_id").alias("id"), T.planted_text(F.col("doc_id"), F.col("text")).alias("comment_text"),
                        T.model_score(F.col("doc_id")).alias("model_score"))
    source = stream_path(docs, f"{sf.rstrip('/')}/documents.parquet")
    q = start_parquet_stream(spark, source, docs.schema, sink, prepare=prep)
    q.awaitTermination()
    # without rows the sink holds no file to take the schema from
    return flat_analysis(spark.read.schema(score_stream(prep(docs)).schema).parquet(sink))


# ---- A: sources and sinks, through CSV files in the shared folder ---------------

def _folder(spark, name: str) -> str:
    import uuid

    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _as_csv(df: DataFrame, name: str) -> str:
    """Write ``df`` as CSV with its columns in another order and one more."""
    cols = sorted(df.columns, key=lambda c: (len(c), c), reverse=True)
    path = _folder(df.sparkSession, name)
    df.select(F.lit('say "no",').alias("extra"), *cols).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r9(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


COMMENT_COLS = ["id", "comment_text", *NUMERIC]
SQL_QUOTED = _comments_sql().replace("text AS comment_text", "'a \"' || text || '\",' || chr(10) || 'b' AS comment_text")


def _quoted(spark, sf) -> DataFrame:
    """Comments whose texts hold quotes, commas and line breaks."""
    c = _comments(spark, sf).select(*COMMENT_COLS)
    return c.withColumn("comment_text", F.concat(F.lit('a "'), "comment_text", F.lit('",\nb')))


@register("read_comments", f"WITH {SQL_QUOTED} SELECT id, comment_text, {', '.join(sql_r9(c) + ' AS ' + c for c in NUMERIC)} FROM comments")
def q_read_comments(spark, sf):
    from ..sources import csv as C
    return _rounded(C.read_comments(spark, _as_csv(_quoted(spark, sf), "comments")).select(*COMMENT_COLS))


def _spoilt(spark, sf) -> DataFrame:
    """Quoted comments as text; every 29th target is no number, nor is every 31st id."""
    c = _quoted(spark, sf).select("id", "comment_text", "target")
    return c.select(F.when(F.col("id") % 31 == 0, F.concat(F.lit("x"), F.col("id"))).otherwise(F.col("id").cast("string")).alias("id"), "comment_text",
                    F.when(F.col("id") % 29 == 0, F.lit("much")).otherwise(F.col("target").cast("string")).alias("target"))


@register("read_comments_reject", f"WITH {SQL_QUOTED} SELECT id, comment_text, {sql_r9('target')} AS target FROM comments WHERE id % 29 <> 0 AND id % 31 <> 0")
def q_read_comments_reject(spark, sf):
    from ..sources import csv as C
    return _rounded(C.read_comments(spark, _as_csv(_spoilt(spark, sf), "comments"), bad="reject").select("id", "comment_text", "target"))


@register("read_comments_bad", f"WITH {SQL_QUOTED} SELECT CASE WHEN id % 31 = 0 THEN 'x' || id ELSE id::VARCHAR END AS id, comment_text FROM comments WHERE id % 29 = 0 OR id % 31 = 0")
def q_read_comments_bad(spark, sf):
    from ..sources import csv as C
    return C.read_comments(spark, _as_csv(_spoilt(spark, sf), "comments"), bad="only").select("id", "comment_text")


@register("read_annotations", f"WITH {_annotations_sql()} SELECT comment_id, {', '.join(sql_r9(c) + ' AS ' + c for c in P.SCORE_COLUMNS)} FROM ann")
def q_read_annotations(spark, sf):
    from ..sources import csv as C
    return _rounded(C.read_annotations(spark, _as_csv(T.annotations(spark, sf), "annotations")).select("comment_id", *P.SCORE_COLUMNS))


@register("load_sources", f"WITH {SQL_QUOTED}, {_annotations_sql()} SELECT 0 AS source_rank, id, comment_text, {sql_r9('target')} AS target, -1::BIGINT AS comment_id, NULL::DOUBLE AS toxic FROM comments "
                          f"UNION ALL SELECT 1, -1, NULL, NULL, comment_id, {sql_r9('avg(toxic)')} FROM ann GROUP BY comment_id")
def q_load_sources(spark, sf):
    """The second source is missing and skipped."""
    from ..sources import csv as C
    a, b = _as_csv(_quoted(spark, sf), "comments"), _as_csv(T.annotations(spark, sf), "annotations")
    df = C.load_sources(spark, [(a, "comments"), (a + "-missing", "comments"), (b, "annotations")])
    return _rounded(df.select("source_rank", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("id", "comment_id")], "comment_text", "target", "toxic"))


@register("training_set_round_trip", f"WITH {_training_sql()} SELECT comment_text, label FROM training")
def q_training_set_round_trip(spark, sf):
    from ..sources import csv as C
    path = _folder(spark, "training")
    C.write_training_set(_training(spark, sf).select("label", "comment_text"), path, "csv")
    return C.read_training_set(spark, path, "csv")


# ---- §3.2: the whole preparation job ------------------------------------------------

@register("prepare_training_set", f"""WITH {_comments_sql()},
d AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY comment_text ORDER BY source_rank, id) AS rn FROM comments) WHERE rn = 1),
filled AS (SELECT id, comment_text, {', '.join(f'coalesce({c}, {D(0)}) AS {c}' for c in NUMERIC)} FROM d),
training AS (SELECT id, comment_text, {_label_sql('v2')} AS label FROM filled),
counts AS (SELECT least(count_if(label = 0), count_if(label = 1), {S.V2_CAP}) AS n FROM training),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_key_sql()}, id) AS rn FROM training),
balanced AS (SELECT id, label FROM ranked, counts WHERE rn <= n)
SELECT id, label, CAST(row_number() OVER (ORDER BY {_key_sql()}, id) AS INTEGER) AS shuffle_rank FROM balanced""")
def q_prepare_training_set(spark, sf):
    from .train import prepare
    ps = prepare(spark, _comments(spark, sf), version="v2")
    return ps.training.select("id", "label", F.col("shuffle_rank").cast("int"))


@register("prepare_counts", f"""WITH {_comments_sql()},
d AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY comment_text ORDER BY source_rank, id) AS rn FROM comments) WHERE rn = 1),
filled AS (SELECT id, target AS raw, {', '.join(f'coalesce({c}, {D(0)}) AS {c}' for c in NUMERIC)} FROM d),
c AS (SELECT count(*) AS total, count_if({_label_sql('v2')} = 1) AS positives, count_if({_label_sql('v2')} = 0) AS negatives,
  count_if(raw > 0.5) AS toxic_n, count_if(raw <= 0.5) AS non_toxic_n FROM filled)
SELECT *, {sql_r9('total::DOUBLE / (2 * negatives)')} AS negative_weight, {sql_r9('total::DOUBLE / (2 * positives)')} AS positive_weight FROM c""")
def q_prepare_counts(spark, sf):
    """D2, D3 and B9 of the prepared table, from its one aggregate."""
    from .train import prepare
    ps = prepare(spark, _comments(spark, sf), version="v2")
    known = {k: v for part in (ps.distribution, ps.target_split, ps.class_weights) for k, v in part.first().asDict().items()}
    counts = [F.lit(known[c]).cast("long").alias(c) for c in ("total", "positives", "negatives", "toxic_n", "non_toxic_n")]
    return spark.range(1).select(*counts, *[r9(F.lit(known[c])).alias(c) for c in ("negative_weight", "positive_weight")])
