"""Seeded sampling, splitting and ordering.

Random draws are replaced by a seeded hash order: ``md5('<seed>:<id>')`` then
``id``. It is stable across runs and partitionings, and equal in Spark and
DuckDB. "The first n rows of a class" is a cut-off in that order, found without
sorting or gathering the class: rows are counted by hash prefix, the prefix in
which the n-th row lies is refined, and only its few rows are ranked. Taking
the sample is then a filter; texts are never shuffled. Any size works alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregate import label_distribution
from .prep import eligible

SEED = 42
V1_CAP = 1000
V2_CAP = 2000
PREFIX = 3          # hex digits of the hash in one step
FEW = 4096          # rows of a border prefix that are ranked one by one
DIGITS = 32         # of an MD5


def sample_key(seed: int, key: str = "id") -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def _first(df: DataFrame, take: DataFrame, seed: int, key: str, group: str | None) -> Column:
    """Whether a row is among the first ``take`` (__g, __n) rows of its group:
    a condition on the columns of ``df``. One small literal per group reaches
    the plan (groups are classes). Rows that share a key are in or out together."""
    g = F.col(group) if group else F.lit(0)
    h, k = sample_key(seed, key), F.col(key)
    rows = df.select(g.cast("string").alias("__g"), h.alias("__h"), k.alias("__k"))
    border = take.filter("__n > 0").select(F.col("__g").cast("string").alias("__g"), "__n", F.lit("").alias("__p"), F.lit(0).cast("long").alias("__before"))
    inside, width = rows, 0
    while True:
        width += PREFIX
        c = inside.groupBy("__g", F.substring("__h", 1, width).alias("__p2")).agg(F.count(F.lit(1)).alias("__c"))
        upto = F.sum("__c").over(Window.partitionBy("__g").orderBy("__p2"))  # 16 ** PREFIX rows a group at most
        c = c.join(F.broadcast(border), "__g").withColumn("__upto", F.col("__before") + upto)
        c = c.filter(F.col("__upto") >= F.col("__n")).groupBy("__g", "__n").agg(F.min(F.struct("__p2", "__upto", "__c")).alias("m"))
        found = c.selectExpr("__g", "__n", "m.__p2 AS __p", "m.__upto - m.__c AS __before", "m.__c AS __c").collect()  # a row per group
        spark = df.sparkSession
        border = spark.createDataFrame([tuple(r)[:4] for r in found], "__g string, __n long, __p string, __before long")
        inside = rows.join(F.broadcast(border.select("__g", "__p")), "__g").filter(F.substring("__h", 1, width) == F.col("__p")).select("__g", "__h", "__k")
        if width >= DIGITS or max([r["__c"] for r in found], default=0) <= FEW:
            break
    rank = F.row_number().over(Window.partitionBy("__g").orderBy("__h", "__k"))
    last = inside.withColumn("__r", rank).join(F.broadcast(border), "__g").filter(F.col("__before") + F.col("__r") == F.col("__n"))
    cuts = {r["__g"]: (r["__h"], r["__k"]) for r in last.select("__g", "__h", "__k").collect()}  # a row per group
    whole = {r["__g"] for r in take.filter("__n > 0").select(F.col("__g").cast("string")).collect()} - set(cuts)
    out = F.lit(False)
    for name, (h1, k1) in sorted(cuts.items()):
        upto = (h < h1) | ((h == h1) & (k <= F.lit(k1)))
        out = out | ((g.cast("string") == name) & upto)
    for name in sorted(whole):  # a group with fewer rows than asked for
        out = out | (g.cast("string") == name)
    return F.coalesce(out, F.lit(False))


def _counts(df: DataFrame, group: str | None) -> DataFrame:
    return df.groupBy((F.col(group) if group else F.lit(0)).cast("string").alias("__g")).agg(F.count(F.lit(1)).alias("__n"))


def _top(df: DataFrame, n: int, seed: int, key: str, group: str | None = None) -> DataFrame:
    """The first ``min(n, rows)`` rows of each group. Keys are row keys; rows that share one
    go together, so a sample may then be larger by its repeats."""
    take = _counts(df, group).select("__g", F.least("__n", F.lit(n)).alias("__n"))
    return df.filter(_first(df, take, seed, key, group))


def balanced_sample(df: DataFrame, label: str = "label", cap: int = V2_CAP, seed: int = SEED,
                    key: str = "id", fallback: str = "all") -> DataFrame:
    """E2 (+ F2, E7): exactly ``min(n0, n1, cap)`` rows of each class.

    With an empty class the sample cannot be drawn; ``fallback='all'``
    returns every row as the published pipeline does, ``'raise'`` stops.
    """
    row = label_distribution(df, label).first()
    n = min(row["negatives"], row["positives"], cap)
    if n == 0:
        if fallback == "all":
            return df
        raise ValueError("No examples found for one or both classes")
    return _top(df.filter(F.col(label).isin(0, 1)), n, seed, key, label)


def class_examples(df: DataFrame, n: int = 5, label: str = "label", text: str = "comment_text",
                   seed: int = SEED, key: str = "id", min_len: int = 50) -> DataFrame:
    """``n`` rows per class among texts longer than ``min_len``."""
    both = eligible(df, 1, label, text, min_len).unionByName(eligible(df, 0, label, text, min_len))
    return _top(both, n, seed, key, label)


def stratified_split(df: DataFrame, test_fraction: float = 0.2, label: str = "label",
                     seed: int = SEED, key: str = "id", exact: bool = True) -> DataFrame:
    """Adds ``split`` = 'val' for ceil(fraction x class size) rows per class, else 'train'.

    ``exact=True`` finds each class's cut-off in the hash order (a few passes
    over key and label); ``exact=False`` puts a row in 'val' when its hash falls
    in the first ``fraction`` of the hash range: no pass, class shares kept in
    expectation only.
    """
    if not exact:
        u = F.conv(F.substring(sample_key(seed, key), 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))
        return df.withColumn("split", F.when(u < test_fraction, "val").otherwise("train"))
    take = _counts(df, label).select("__g", F.ceil(F.col("__n") * F.lit(test_fraction)).alias("__n"))
    return df.withColumn("split", F.when(_first(df, take, seed, key, label), "val").otherwise("train"))


def shuffle(df: DataFrame, seed: int = SEED, key: str = "id", with_rank: bool = True) -> DataFrame:
    """E5: seeded order. ``with_rank`` adds the 1-based rank (``shuffle_rank``, a long):
    rows are ranked within their hash prefix, and the counts of the prefixes
    before it (two levels, at most 256 rows each) are added. Without it the
    result is a distributed range-partitioned sort."""
    h = sample_key(seed, key)
    if not with_rank:
        return df.orderBy(h, F.col(key))
    keyed = df.withColumn("__p", F.substring(h, 1, 5))
    counts = keyed.groupBy("__p").agg(F.count(F.lit(1)).alias("__c")).withColumn("__hi", F.substring("__p", 1, 2))
    before, total = {}, 0
    for r in sorted(counts.groupBy("__hi").agg(F.sum("__c").alias("c")).collect(), key=lambda r: r["__hi"]):  # 256 rows
        before[r["__hi"]], total = total, total + r["c"]
    offset = F.lit(0)
    if before:
        offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("__hi"))
    below = Window.partitionBy("__hi").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
    counts = counts.select("__p", (offset + F.coalesce(F.sum("__c").over(below), F.lit(0))).alias("__before"))
    w = Window.partitionBy("__p").orderBy(h, F.col(key))
    ranked = keyed.withColumn("__r", F.row_number().over(w)).join(counts, "__p")
    return ranked.select(*[F.col(c) for c in df.columns], (F.col("__before") + F.col("__r")).cast("long").alias("shuffle_rank"))


def debug_sample(df: DataFrame, n: int = 1000, seed: int = SEED, key: str = "id") -> DataFrame:
    """``min(n, rows)`` seeded rows."""
    return _top(df, n, seed, key)


def best_candidate(metrics: DataFrame) -> DataFrame:
    """Highest validation F1 above 0; the first of equals (lowest ordinal) wins."""
    cols = metrics.columns
    return (metrics.filter(F.col("val_f1") > 0)
            .agg(F.max_by(F.struct(*cols), F.struct(F.col("val_f1"), -F.col("ordinal"))).alias("b"))
            .filter(F.col("b").isNotNull())
            .select(*[F.col("b")[c].alias(c) for c in cols]))

