"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed hash. A source's target is met by whole repeats of
all its documents and, for what is left, by the documents whose hash is below a
threshold. The threshold is found without sorting documents: sizes are summed
by source and hash bucket, the bucket in which the budget runs out is split into
finer buckets, and so on until it holds a few documents, which alone are ranked.
Rows of one id share a hash; where the threshold falls among them, a second hash,
of the texts, is split the same way, and of equal rows as many are taken as fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slantscan.llm.common import Scratch

WEIGHTS = (3, 1, 2)
SHARE = 1.5  #: words of the mix as a part of all words
MOST = 2  #: times that a document is taken at most
BITS, LEVEL = 60, 10  #: bits of the hash, and of them in one histogram
FEW = 4096  #: documents of a boundary bucket that are ranked one by one
RUN = 4096  #: equal rows that one row stands for when they are written out again

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size -> the same with ``target``.

    Sources in code point order, null last, get the weights in turn. The mix
    holds ``share`` of all words; a source gets its weight's part, but ``most``
    times its size at most, and the excess goes to the others by weight: with
    sources in order of size per weight, the first that needn't be cut fixes
    what one unit of weight gets. One row per source is ranked.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("i") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("i", F.row_number().over(by_name)).withColumn("weight", weight)
    s = s.withColumn("cap", F.lit(most) * F.col("source_size"))
    tight = Window.orderBy(F.col("cap") / F.col("weight"), "i")
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    rest = tight.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
    s = s.withColumn("unit", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    s = s.withColumn("unit", F.when(F.col("unit") * F.col("weight") <= F.col("cap"), F.col("unit")))
    s = s.withColumn("unit", F.max("unit").over(everything))  # it falls after the first that needn't be cut
    return s.select("source", "source_size", F.least(F.coalesce(F.col("unit") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double")).alias("target"))


def takes(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    ``size`` counts the words of the text (null: 0); ``taken`` is the size times
    0, 1 or more, never beyond ``most``. A source's taken words miss its target
    by half of one row's size at most, repeated ids and equal rows included. A
    null source is a source of its own. Rows that repeat an id are taken alike
    unless the threshold falls among them; a null id is hashed by its text.
    Reruns agree, whatever the partitions. An empty table gives none. Other
    columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    d = scratch.save(d.select("doc_id", "source", "size", hashed("doc_id", "text").alias("h"), _second("doc_id", "text")), "sizes")
    t, repeated = thresholds(d, scratch, weights, share, most)
    out = d.alias("d").join(t.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", *[c for c in t.columns if c != "source"])
    if not repeated:
        copies = _copies()
    else:
        equal = out.where(_at_edge()).groupBy("doc_id", "size", "source_size", "target", "whole", "fit").agg(F.count("*").alias("n"))
        copies = F.col("copies")
        out = out.where(~_at_edge()).withColumn("copies", _copies()).unionByName(_apart(equal), allowMissingColumns=True)
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"))


def hashed(doc_id, text):
    """The document's fixed hash: BITS bits of the id's MD5, for a null id of the text's."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce(F.col(text), F.lit("")))))
    return F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 10).cast("long")


def _second(*columns) -> Column:
    """The hash that orders rows of one first hash: rows that share it too count as equal."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - BITS).alias("h2")


def _at_edge() -> Column:
    """Whether a row is one of the equal rows among which the budget runs out."""
    return F.coalesce((F.col("h") == F.col("at")) & (F.col("h2") == F.col("at2")), F.lit(False))


def _copies() -> Column:
    """How often a row is taken that has no equal."""
    below = (F.col("h") < F.col("at")) | (F.col("h") == F.col("at")) & (F.col("h2") < F.col("at2"))
    return (F.col("whole") + F.when(_at_edge(), F.col("fit")).otherwise(F.coalesce(below, F.lit(False)).cast("long"))).cast("int")


def _apart(equal: DataFrame) -> DataFrame:
    """``n`` rows for each row of ``equal``, with ``copies``: the first ``fit`` are taken once more."""
    run = equal.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}"))))
    run = run.repartition(F.xxhash64("run", "n"))  # a great many of one row are written by several tasks
    one = run.withColumn("i", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1)))
    return one.withColumn("copies", (F.col("whole") + (F.col("i") < F.col("fit")).cast("long")).cast("int")).drop("run", "i", "n")


def thresholds(d: DataFrame, scratch: Scratch, weights=WEIGHTS, share=SHARE, most=MOST) -> tuple[DataFrame, bool]:
    """source, size, h, h2 -> per source: source_size, target, whole (repeats of all
    its rows), at and at2 (the hashes of the row in which the rest of the budget
    runs out; all before it are taken once more) and fit (how many of the rows with
    these hashes are); and whether any such rows are more than one."""
    t = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    t = t.withColumn("whole", whole.cast("long")).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    t = scratch.save(t, "targets")

    known = t.select("source", "budget", F.lit(0).cast("long").alias("used"))
    inside, edge = _edge(d.where("size > 0"), known, "h", scratch)
    _, edge2 = _edge(inside, edge, "h2", scratch)
    repeated = (edge2.agg(F.max("n")).first()[0] or 0) > 1
    # a row is taken while its middle lies within the budget
    fit = F.least(F.col("n"), F.floor((F.col("budget") - F.col("used")) * F.col("n") / F.col("s") + 0.5)).cast("long")
    edge2 = edge2.select("source", F.col("low").alias("at2"), fit.alias("fit"))
    edge = edge.select("source", F.col("low").alias("at"))
    for more in (edge, edge2):
        t = t.alias("t").join(more.alias("k"), F.col("t.source").eqNullSafe(F.col("k.source")), "left").select("t.*", *[f"k.{c}" for c in more.columns if c != "source"])
    return scratch.save(t.drop("budget"), "thresholds"), repeated


def _edge(inside: DataFrame, known: DataFrame, by: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows of ``inside`` that have the value of hash ``by`` in which their source's budget
    runs out, and per source: budget, used (words before them), low (the value), s and n of them."""
    bits = BITS
    while True:
        bits -= LEVEL
        # at most 2 ** LEVEL rows a source
        hist = inside.groupBy("source", F.shiftright(by, bits).alias("bucket")).agg(F.sum("size").alias("s"), F.count("*").alias("n"))
        known = scratch.save(_reached(hist, known, "bucket"), f"{by}-edge{bits}")
        few = (known.agg(F.max("n")).first()[0] or 0) <= FEW
        inside = scratch.save(_lies(inside, known, F.shiftright(f"e.{by}", bits)), f"{by}-inside{bits}")
        if few or bits == 0:
            break
    single = inside.groupBy("source", by).agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    known = scratch.save(_reached(single, known, by), f"{by}-edge")
    return _lies(inside, known, F.col(f"e.{by}")), known


def _lies(inside: DataFrame, known: DataFrame, value: Column) -> DataFrame:
    return inside.alias("e").join(known.alias("k"), F.col("e.source").eqNullSafe(F.col("k.source")) & (value == F.col("k.low"))).select("e.*")


def _reached(sums: DataFrame, known: DataFrame, by: str) -> DataFrame:
    """Per source the first row of ``sums``, in order of ``by``, with which its budget is reached."""
    j = sums.alias("e").join(known.alias("k"), F.col("e.source").eqNullSafe(F.col("k.source")))
    j = j.select("e.*", "k.budget", "k.used")
    j = j.withColumn("upto", F.col("used") + F.sum("s").over(Window.partitionBy("source").orderBy(by)))
    edge = j.where(F.col("upto") >= F.col("budget")).groupBy("source", "budget").agg(F.min(F.struct(by, "upto", "s", "n")).alias("m"))
    return edge.selectExpr("source", "budget", "m.upto - m.s AS used", f"m.{by} AS low", "m.s AS s", "m.n AS n")


def mixed(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns kept."""
    scratch = Scratch(docs.sparkSession)
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    source = F.col(source_col).cast("string")
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source.alias("source"), size.alias("size"), hashed(id_col, text_col).alias("h"), _second(*plain))
    d = scratch.save(keyed.select("source", "size", "h", "h2"), "sizes")
    t, repeated = thresholds(d, scratch, **how)
    out = keyed.alias("d").join(t.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).where("d.size > 0").select("row", "h", "h2", "whole", "at", "at2", "fit")
    if not repeated:
        out = out.withColumn("copies", _copies())
    else:
        equal = out.where(_at_edge()).groupBy(F.to_json("row").alias("text"), "whole", "fit").agg(F.first("row").alias("row"), F.count("*").alias("n"))
        out = out.where(~_at_edge()).withColumn("copies", _copies()).select("row", "copies").unionByName(_apart(equal).select("row", "copies"))
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
