"""DuckDB SQL for the correctness oracle.

Term tests are written with plain ``contains`` per term (not the one-pass
regex the Spark plans use), and each rule chain as one CTE per step, so the
oracle is an independent statement of the same rules. Decimal literals are
written as ``::DOUBLE``: a bare ``0.4`` is DECIMAL in DuckDB and would change
sums and products.
"""

from __future__ import annotations

from .. import lexicons as L
from ..functions.text import WS_CLASS
from ..sources.tables import PLANTED_SENTENCES


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def D(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def hit(t: str, col: str = "lt") -> str:
    return f"contains({col}, {q(t)})"


def count(terms, col: str = "lt") -> str:
    if not terms:
        return "0"
    return "(" + " + ".join(f"CAST({hit(t, col)} AS INTEGER)" for t in terms) + ")"


def any_(terms, col: str = "lt") -> str:
    if not terms:
        return "FALSE"
    return "(" + " OR ".join(hit(t, col) for t in terms) + ")"


def raw_hit(t: str) -> str:
    """Term in the raw lower-cased text (``lraw``)."""
    return hit(t, "lraw")


def any_raw(terms) -> str:
    return any_(terms, "lraw")


def normalise(expr: str) -> str:
    return f"trim(regexp_replace({expr}, {q(WS_CLASS)}, ' ', 'g'))"


def planted_sql(doc: str = "doc_id", text: str = "text") -> str:
    arr = "[" + ", ".join(q(s) for s in PLANTED_SENTENCES) + "]"
    n = len(PLANTED_SENTENCES)
    s1 = f"{arr}[(({doc} * 7) % {n}) + 1]"
    s2 = f"{arr}[(({doc} * 11 + 5) % {n}) + 1]"
    return (f"CASE WHEN {doc} % 4 = 0 THEN {text} "
            f"WHEN {doc} % 4 = 1 THEN {text} || ' ' || {s1} "
            f"ELSE {text} || ' ' || {s1} || ' ' || {s2} END")


def model_sql(doc: str = "doc_id") -> str:
    return f"((({doc} * 37) % 101) / {D(100.0)})"


def planted_cte() -> str:
    return (f"src AS (SELECT doc_id AS id, {planted_sql()} AS comment_text, "
            f"{model_sql()} AS model_score FROM documents)")


def norm_cte(src: str = "src", text: str = "comment_text") -> str:
    lowered = "lower(" + normalise(f"coalesce({text}, '')") + ")"
    return f"norm AS (SELECT *, {lowered} AS lt, lower(coalesce({text}, '')) AS lraw FROM {src})"


def seq(parts: list[str]) -> str:
    out = D(0.0)
    for p in parts:
        out = f"({out} + {p})"
    return out


def when(cond: str, a: str, b: str | None = None) -> str:
    return f"CASE WHEN {cond} THEN {a} ELSE {b if b is not None else D(0.0)} END"


# ---- V2 features --------------------------------------------------------------

def coverage(groups: dict, col: str = "lt") -> str:
    n = len(groups)
    body = " + ".join(f"CAST({any_(v, col)} AS INTEGER)" for v in groups.values())
    return f"(({body}) / {D(n)})"


def v2_feature_exprs(L=L) -> dict[str, str]:
    econ = seq([when(f"{hit(p)} AND {any_(s)}", D(0.7)) for p, s in L.V2_ECONOMIC_CONTRAST_PAIRS])
    posres = seq([when(f"{hit(p)} AND {any_(s)}", D(0.8)) for p, s in L.V2_POSITIVE_RESEARCH_PATTERNS])
    fm = any_(L.V2_FACTUAL_DISCUSSION_MARKERS)
    legit_parts = []
    for p, s in L.V2_LEGITIMATE_SYSTEMIC_PATTERNS:
        legit_parts.append(when(f"{hit(p)} AND {any_(s)}", D(0.6)))
        legit_parts.append(when(f"{hit(p)} AND {any_(s)} AND {fm}", D(0.2)))
    eq = D(0.0)
    for v in L.V2_EVIDENCE_MARKERS["high_quality"].values():
        eq = f"({eq} + {when(any_(v), D(0.2))})"
    for v in L.V2_EVIDENCE_MARKERS["low_quality"].values():
        eq = f"({eq} - {when(any_(v), D(0.2))})"
    dec = f"{count(L.V2_CULTURAL_DECLINE_TERMS)} > 0"
    usv = f"{count(L.V2_US_VS_THEM_TERMS)} > 0"
    return {
        "explicit_n": count(L.EXPLICIT_RACIAL_TERMS),
        "coded_n": count(L.V2_CODED_RACIAL_TERMS),
        "stereotype_n": count(L.V2_RACIAL_STEREOTYPES),
        "hist": when(f"{any_(L.V2_HISTORICAL_TERMS)} AND {any_(L.V2_EDUCATIONAL_TERMS)} AND {any_(L.V2_CRITICAL_TERMS)}", D(0.8)),
        "cult": f"CASE WHEN ({dec}) AND ({usv}) THEN {D(0.7)} WHEN ({dec}) OR ({usv}) THEN {D(0.5)} ELSE {D(0.0)} END",
        "sys": when(f"{any_(L.V2_SYSTEMIC_TERMS)} AND {any_(L.V2_SOLUTION_TERMS)} AND {any_(L.V2_FACTUAL_MARKERS)}", D(0.8)),
        "econ": econ,
        "posres": posres,
        "legit": seq(legit_parts),
        "eq": eq,
        "fact": coverage(L.V2_INTENT_MARKERS["factual_discussion"]),
        "fm": fm,
        "blame": any_(L.V2_BLAME_TERMS),
        "refusal": any_(L.V2_REFUSAL_TERMS),
        "pos_r": any_(L.V2_POSITIVE_RESEARCH_TERMS),
        "neg_r": any_(L.V2_NEGATIVE_RESEARCH_TERMS),
        "strong": any_(L.V2_STRONG_INDICATORS),
        "demo_changes": hit("demographic changes"),
        "minority_comm": hit("minority communities"),
    }


def v2_chain_ctes(feat: str = "feat") -> str:
    """Rule chain of the V2 detector, one CTE per step; ends in ``v2`` with column ``score``."""
    return f"""
b0 AS (SELECT *, greatest((explicit_n * {D(0.4)} + coded_n * {D(0.4)}) + stereotype_n * {D(0.4)}, {D(0.0)}) AS b FROM {feat}),
b1 AS (SELECT * REPLACE (CASE WHEN hist > 0.5 THEN b * {D(0.1)} ELSE b END AS b) FROM b0),
b2 AS (SELECT * REPLACE (CASE WHEN hist > 0.5 AND eq > 0 THEN b * {D(0.5)} ELSE b END AS b) FROM b1),
b3 AS (SELECT * REPLACE (CASE WHEN cult > 0 THEN greatest(b, cult) ELSE b END AS b) FROM b2),
b4 AS (SELECT * REPLACE (CASE WHEN sys > 0.5 AND eq > 0 AND fact > 0.5 AND NOT blame THEN b * {D(0.1)} ELSE b END AS b) FROM b3),
b5 AS (SELECT * REPLACE (CASE WHEN pos_r AND NOT neg_r AND fact > 0.5 THEN b * {D(0.2)} ELSE b END AS b) FROM b4),
b6 AS (SELECT * REPLACE (CASE WHEN strong THEN greatest(b, {D(0.8)}) ELSE b END AS b) FROM b5),
f0 AS (SELECT *, {D(0.3)} * model_score + {D(0.7)} * b AS f FROM b6),
f1 AS (SELECT * REPLACE (CASE WHEN hist > 0.7 THEN f * {D(0.2)} ELSE f END AS f) FROM f0),
f2 AS (SELECT * REPLACE (CASE WHEN cult > 0.6 THEN greatest(f, {D(0.6)}) ELSE f END AS f) FROM f1),
f3 AS (SELECT * REPLACE (CASE WHEN sys > 0.7 AND eq > 0 AND NOT blame THEN f * {D(0.2)} ELSE f END AS f) FROM f2),
f4 AS (SELECT * REPLACE (CASE WHEN econ > 0.6 THEN greatest(f, econ) ELSE f END AS f) FROM f3),
f5 AS (SELECT * REPLACE (CASE WHEN posres > 0.7 AND eq > 0 THEN f * {D(0.1)} ELSE f END AS f) FROM f4),
f6 AS (SELECT * REPLACE (CASE WHEN legit > 0.6 AND eq > 0 AND NOT refusal THEN f * {D(0.1)} ELSE f END AS f) FROM f5),
f7 AS (SELECT * REPLACE (CASE WHEN demo_changes AND posres > 0.6 THEN f * {D(0.1)} ELSE f END AS f) FROM f6),
f8 AS (SELECT * REPLACE (CASE WHEN minority_comm AND legit > 0.6 AND fm THEN f * {D(0.1)} ELSE f END AS f) FROM f7),
v2 AS (SELECT *, least(greatest(f, {D(0.0)}), {D(1.0)}) AS score FROM f8)"""


def v2_feat_cte(src: str = "norm", keep: str = "id, model_score, lt, lraw", L=L) -> str:
    cols = ",\n  ".join(f"{e} AS {k}" for k, e in v2_feature_exprs(L).items())
    return f"feat AS (SELECT {keep},\n  {cols}\n FROM {src})"


def score_v2_sql(L=L) -> str:
    """``L``: the lists, those of ``lexicons`` or others under the same names."""
    return f"""WITH {planted_cte()},
{norm_cte()},
{v2_feat_cte(L=L)},
{v2_chain_ctes()}
SELECT id, round(score, 9) AS bias_score, score > {D(L.BIAS_THRESHOLD)} AS is_biased FROM v2"""


# ---- V2 explanation -------------------------------------------------------------

def relation_exprs(col: str = "lt") -> dict[str, str]:
    names = {("research_findings", "positive"): "positive_research",
             ("research_findings", "negative"): "negative_research",
             ("systemic_discussion", "factual"): "factual_systemic",
             ("systemic_discussion", "biased"): "biased_systemic"}
    out = {}
    for group, kinds in L.V2_CONTEXTUAL_RELATIONSHIPS.items():
        for kind, pairs in kinds.items():
            s = seq([when(f"{hit(a, col)} AND {hit(b, col)}", D(0.3)) for a, b in pairs])
            out[names[(group, kind)]] = f"least({s}, {D(1.0)})"
    return out


def structure_exprs() -> dict[str, str]:
    return {name: coverage(comps) for name, comps in L.V2_STATEMENT_STRUCTURES.items()}


def fmt2(x: str) -> str:
    return f"printf('%.2f', {x})"


def band(x: str) -> str:
    return (f"CASE WHEN {x} > 0.8 THEN 'highly confident' WHEN {x} > 0.6 THEN 'moderately confident' "
            f"ELSE 'somewhat confident' END")


def tag_list(items: list[tuple[str, str]]) -> str:
    """Ordered names whose condition holds, as a DuckDB list."""
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(n)} END" for c, n in items) + "], lambda x: x IS NOT NULL)"


def v2_tags_expr() -> str:
    return tag_list([
        (any_raw(L.EXPLICIT_RACIAL_TERMS), "explicit racial terms"),
        (any_raw(L.V2_CODED_RACIAL_TERMS), "coded racial language"),
        (any_raw(L.V2_RACIAL_STEREOTYPES), "racial stereotyping"),
        (any_raw(L.V2_ECONOMIC_BIAS_TERMS), "economic bias language"),
        ("st_factual_research > 0.5", "research-based language"),
        ("st_systemic_analysis > 0.5", "systemic analysis"),
        ("st_biased_generalization > 0.5", "biased generalizations"),
        ("rel_positive_research > 0.3", "positive research findings"),
        ("rel_negative_research > 0.3", "negative research claims"),
        ("rel_factual_systemic > 0.3", "factual systemic discussion"),
        ("rel_biased_systemic > 0.3", "biased systemic claims"),
    ])


def explanation_sql(conf: str, tags: str, middle: str = "''") -> str:
    return (f"CASE WHEN NOT ({conf} > {D(L.BIAS_THRESHOLD)}) THEN {q(L.NOT_BIASED_EXPLANATION)} ELSE "
            f"'The text shows signs of bias (confidence: ' || {fmt2(conf)} || '). ' || "
            f"'The model is ' || {band(conf)} || ' this text contains bias. ' || {middle} || "
            f"CASE WHEN len({tags}) > 0 THEN 'Detected patterns include: ' || array_to_string({tags}, ', ') || '. ' ELSE '' END || "
            f"CASE WHEN {conf} > 0 THEN 'Racial bias score: ' || {fmt2(conf)} ELSE '' END END")


def v2_middle(conf: str = "score") -> str:
    return (
        "(CASE WHEN st_factual_research > 0.5 THEN "
        "CASE WHEN rel_positive_research > 0.3 THEN 'While the text uses research-based language to present findings, ' || "
        f"CASE WHEN {conf} > 0.6 THEN 'it appears to use this framework to mask bias. ' ELSE '' END "
        "ELSE 'The text uses academic language to present biased views. ' END ELSE '' END || "
        "CASE WHEN st_systemic_analysis > 0.5 THEN "
        "CASE WHEN rel_factual_systemic > 0.3 THEN 'The text discusses systemic issues, but ' || "
        f"CASE WHEN {conf} > 0.6 THEN 'may use this framework to express bias. ' ELSE '' END "
        "ELSE 'The text uses systemic analysis to present biased views. ' END ELSE '' END)"
    )


def v2_analysis_ctes(src_cte: str | None = None) -> str:
    """src -> norm -> feat (+ structures, raw relations) -> chain -> ``v2``.

    ``src_cte`` defines ``src(id, comment_text, model_score)``; default: the
    planted corpus."""
    extra = [f"{e} AS st_{k}" for k, e in structure_exprs().items()]
    extra += [f"{e} AS rel_{k}" for k, e in relation_exprs("lraw").items()]
    feat = v2_feat_cte()
    feat = feat.replace("\n FROM norm)", ",\n  " + ",\n  ".join(extra) + "\n FROM norm)")
    return f"""{src_cte or planted_cte()},
{norm_cte()},
{feat},
{v2_chain_ctes()},
v2t AS (SELECT *, {v2_tags_expr()} AS tags FROM v2)"""


SUGGESTION_RACE = L.SUGGESTIONS["race"]


# ---- V1 features ------------------------------------------------------------------

def v1_window_ctes(src: str = "norm", L=L) -> str:
    cols = []
    for i, (base, ctx) in enumerate(L.V1_CONTEXTUAL_PAIRS):
        cols.append(f"coalesce(list_position(words, {q(base)}), 0) AS p{i}")
    pos = f"pos AS (SELECT *, {', '.join(cols)} FROM (SELECT *, string_split(lt, ' ') AS words FROM {src}))"
    wins = []
    for i, _ in enumerate(L.V1_CONTEXTUAL_PAIRS):
        wins.append(f"CASE WHEN p{i} > 0 THEN words[greatest(1, p{i} - 5):least(len(words), p{i} + 5)] "
                    f"ELSE []::VARCHAR[] END AS w{i}")
    win = f"win AS (SELECT *, {', '.join(wins)} FROM pos)"
    return pos + ",\n" + win


def v1_context_exprs(col: str = "lt", L=L) -> tuple[str, str, str]:
    """(pair score, score before cap, ordered tags) over windows w0..w14 and text ``col``."""
    pair_parts, pair_tags = [], []
    for i, (base, ctx) in enumerate(L.V1_CONTEXTUAL_PAIRS):
        n = "(" + " + ".join(f"CAST(list_contains(w{i}, {q(c)}) AS INTEGER)" for c in ctx) + ")"
        first = "CASE " + " ".join(f"WHEN list_contains(w{i}, {q(c)}) THEN {q(c)}" for c in ctx) + " END"
        pair_parts.append(when(f"{n} > 0", f"{D(0.15)} * {n}"))
        pair_tags.append((f"{n} > 0", f"{q(base + '-')} || {first}"))
    pseudo = count(L.V1_PSEUDO_SCIENTIFIC_TERMS, col)
    sup = count(L.V1_CULTURAL_SUPREMACY_TERMS, col)
    prop = count(L.V1_PROPERTY_ECONOMIC_TERMS, col)
    s = seq(pair_parts)
    s = f"({s} + {when(f'{pseudo} > 0', f'{D(0.2)} * {pseudo}')})"
    s = f"({s} + {when(f'{sup} > 0', f'{D(0.2)} * {sup}')})"
    s = f"({s} + {when(f'{prop} > 0', f'{D(0.15)} * {prop}')})"
    first_tags = [f"CASE WHEN {c} THEN {v} END" for c, v in pair_tags] + [
        f"CASE WHEN {pseudo} > 0 THEN {q(L.V1_TAG_PSEUDO)} END",
        f"CASE WHEN {sup} > 0 THEN {q(L.V1_TAG_SUPREMACY)} END",
        f"CASE WHEN {prop} > 0 THEN {q(L.V1_TAG_PROPERTY)} END",
    ]
    kinds = "len(list_distinct([" + ", ".join(first_tags) + "]))"
    s = f"({s} * CASE WHEN {kinds} > 1 THEN 1.0::DOUBLE + {D(0.1)} * {kinds} ELSE {D(1.0)} END)"
    hist = count(L.V1_HISTORICAL_BIAS_TERMS, col)
    anal = count(L.V1_ANALYTICAL_BIAS_TERMS, col)
    groups = count(L.EXPLICIT_RACIAL_TERMS, col)
    war = f"({any_(L.V1_WAR_TERMS, col)} AND {groups} > 0)"
    s = f"({s} + {when(f'{hist} > 0', f'{D(0.2)} * {hist}')})"
    s = f"({s} + {when(f'{anal} > 0', f'{D(0.15)} * {anal}')})"
    s = f"({s} + {when(f'{groups} >= 3', D(0.25))})"
    s = f"({s} + {when(war, D(0.2))})"
    tags = "list_filter([" + ", ".join(first_tags + [
        f"CASE WHEN {hist} > 0 THEN {q(L.V1_TAG_HISTORICAL)} END",
        f"CASE WHEN {anal} > 0 THEN {q(L.V1_TAG_ANALYTICAL)} END",
        f"CASE WHEN {groups} >= 3 THEN {q(L.V1_TAG_GROUPS)} END",
        f"CASE WHEN {war} THEN {q(L.V1_TAG_WAR)} END",
    ]) + "], lambda x: x IS NOT NULL)"
    return seq(pair_parts), s, tags


def v1_score_ctes(src_cte: str | None = None, L=L) -> str:
    """src -> norm -> windows -> v1 features -> ``v1`` with columns score, tags, rawtags."""
    _, ctx, tags = v1_context_exprs("lt", L)
    _, _, rawtags = v1_context_exprs("lraw", L)
    feat = f"""v1f AS (SELECT id, model_score, lt, lraw,
  {count(L.EXPLICIT_RACIAL_TERMS)} * {D(0.35)} AS explicit,
  {count(L.V1_CODED_RACIAL_TERMS)} * {D(0.30)} AS coded,
  {count(L.V1_RACIAL_STEREOTYPES)} * {D(0.35)} AS stereo,
  {any_(L.V1_ECONOMIC_TERMS)} AND {any_(L.V1_STEREOTYPE_TERMS)} AS econ_stereo,
  least({ctx}, {D(1.0)}) AS ctx,
  {tags} AS tags,
  {rawtags} AS rawtags
 FROM win)"""
    chain = f"""v1a AS (SELECT *,
  CASE WHEN econ_stereo THEN stereo * {D(1.5)} ELSE stereo END AS stereo2,
  CASE WHEN list_contains(tags, {q(L.V1_TAG_HISTORICAL)}) AND list_contains(tags, {q(L.V1_TAG_GROUPS)}) THEN ctx * {D(1.4)} ELSE ctx END AS ctx2
 FROM v1f),
v1b AS (SELECT *, {D(0.35)} * model_score + {D(0.65)} * least(((explicit + coded) + stereo2) + ctx2, {D(1.0)}) AS s0 FROM v1a),
v1c AS (SELECT *, CASE WHEN len(tags) >= 2 THEN least(s0 * ({D(1.0)} + {D(0.15)} * len(tags)), {D(1.0)}) ELSE s0 END AS s1 FROM v1b),
v1 AS (SELECT *, CASE WHEN list_contains(tags, {q(L.V1_TAG_ANALYTICAL)}) AND len(tags) > 1 THEN least(s1 * {D(1.2)}, {D(1.0)}) ELSE s1 END AS score FROM v1c)"""
    return f"""{src_cte or planted_cte()},
{norm_cte()},
{v1_window_ctes(L=L)},
{feat},
{chain}"""


def v1_pattern_tags_expr() -> str:
    head = tag_list([
        (any_raw(L.EXPLICIT_RACIAL_TERMS), "explicit racial terms"),
        (any_raw(L.V1_CODED_RACIAL_TERMS), "coded racial language"),
        (any_raw(L.V1_RACIAL_STEREOTYPES), "racial stereotyping"),
        (any_raw(L.V1_PSEUDO_SCIENTIFIC_TERMS), "pseudo-scientific racial bias"),
        (any_raw(L.V1_PROPERTY_ECONOMIC_TERMS), "economic-based racial bias"),
        (any_raw(L.V1_CULTURAL_SUPREMACY_TERMS), "cultural supremacy bias"),
    ])
    return f"list_concat({head}, rawtags)"
