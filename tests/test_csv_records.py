"""CSV records cut in byte ranges: equal to the one-task reader, whatever the ranges; row checks that nothing prunes."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from slantscan.operators import aggregate as AG
from slantscan.operators import prep as P
from slantscan.sources import csv as C
from slantscan.sources import records as R


@pytest.fixture
def ranges(spark):
    """Sets the size of the byte ranges."""
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(k) for k in keys]

    def size(n):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], "0")
    yield size
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


def folder():
    return tempfile.mkdtemp(prefix="slantscan-csv-")


def random_cell(rng):
    kind = rng.random()
    if kind < 0.35:
        return "".join(rng.choice("ab é5") for _ in range(rng.randrange(6)))
    if kind < 0.45:  # a quote inside a cell that isn't quoted
        return "x" + "".join(rng.choice('a" ') for _ in range(rng.randrange(5)))
    return '"' + "".join(rng.choice(["a", ",", "\n", '""', "b", "\n\n", '"",""', '\n""']) for _ in range(rng.randrange(9))) + '"'


def random_file(rng, end):
    rows = [f"{i},{random_cell(rng)},{random_cell(rng)}" for i in range(rng.randrange(1, 20))]
    return ("id,a,b" + end + end.join(rows) + rng.choice(["", end])).encode()


def one_task(spark, path):
    how = {"quote": '"', "escape": '"', "columnNameOfCorruptRecord": "__line"}
    df = spark.read.options(**how, header=True, multiLine=True).schema("id string, a string, b string, __line string").csv(path)
    return sorted((tuple(r) for r in df.collect()), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", [11, 60, 100_000])
def test_equal_to_the_one_task_reader(spark, ranges, size):
    rng = random.Random(size)
    for _ in range(3):
        d = folder()
        for k in range(2):
            with open(os.path.join(d, f"part-{k}.csv"), "wb") as f:
                f.write(random_file(rng, "\n"))
        want = one_task(spark, d)
        ranges(size)
        assert rows_of(C._raw(spark, d, True)) == want


def test_crlf_and_empty_lines(spark, ranges):
    d = folder()
    with open(os.path.join(d, "a.csv"), "wb") as f:
        f.write(b'\r\nid,a,b\r\n1,x,"y\r\nz"\r\n\r\n2,"""q"",",\r\n')
    for size in (9, 1000):
        ranges(size)
        assert rows_of(C._raw(spark, d, True)) == [("1", "x", "y\r\nz", None), ("2", '"q",', None, None)]


def test_a_record_over_many_ranges(spark, ranges):
    d = folder()
    text = "line, with a comma\nand \"\"quotes\"\"\n" * 60
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write(f'id,a,b\n1,x,"{text}"\n2,y,z\n3,"{text}",w\n')
    ranges(64)
    got = {r.id: r for r in C._raw(spark, d, True).collect()}
    assert got["1"].b == text.replace('""', '"') and got["2"].b == "z" and got["3"].a == text.replace('""', '"')
    parts = spark.read.option("lineSep", "\n").text(d).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 30  # read in many tasks


def test_an_unclosed_cell_at_the_end_is_kept(spark, ranges):
    d = folder()
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write('id,a,b\n1,x,y\n2,"open,\nmore')
    for size in (6, 1000):
        ranges(size)
        got = rows_of(C._raw(spark, d, True))
        assert got[0] == ("1", "x", "y", None) and len(got) == 2 and got[1][3] is not None  # a bad row, not a lost one


def test_files_with_other_headers_are_refused(spark):
    d = folder()
    for name, head in (("a.csv", "id,a"), ("b.csv", "a,id")):
        with open(os.path.join(d, name), "w") as f:
            f.write(f"{head}\n1,2\n")
    with pytest.raises(Exception, match="headers differ"):
        C._raw(spark, d, True).count()


def test_states_of_lines():
    for line, outside, inside in [
        (b"a,b", False, True), (b'a,"b', True, False), (b'"a""b",c', False, False), (b'a"b,c', False, False), (b'""', False, True),
        (b'x,""', False, True), (b'"', True, False), (b'"",""', False, True), (b'a",b', False, False), (b'a","b', True, True), (b'"a"x"y,"z', True, True), (b'', False, True),
    ]:
        assert (R.leaves_inside(line, False), R.leaves_inside(line, True)) == (outside, inside), line


BAD = "id,comment_text,target,identity_attack,black,other\n1,good,0.9,0.5,0.5,a\n2,bad number,much,0,0,b\n3,too few\n4,too many,0.1,0,0,c,d\n5,empty,,,,e\n"
CONSUMERS = {
    "collect": lambda d: d.collect(),
    "count": lambda d: d.count(),
    "select": lambda d: d.select("target").collect(),
    "text": lambda d: d.select("comment_text").collect(),
    "target_split": lambda d: P.target_split(d).collect(),
    "labels": lambda d: AG.label_distribution(P.fill_missing(d.select("id", F.col("black").alias("label")))).collect(),
    "filter": lambda d: d.where("id = 1").select("id").count(),
    "limit": lambda d: d.groupBy("id").count().collect(),
    "filled": lambda d: P.fill_missing(d).agg(F.sum("target")).collect(),
}


@pytest.mark.parametrize("multi_line", [True, False])
@pytest.mark.parametrize("consumer", CONSUMERS)
def test_a_bad_row_stops_every_consumer(spark, consumer, multi_line):
    d = folder()
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write(BAD)
    with pytest.raises(Exception, match="doesn't fit its columns"):
        CONSUMERS[consumer](C.read_comments(spark, d, multi_line=multi_line))
    assert P.target_split(C.read_comments(spark, d, multi_line=multi_line, bad="reject")).first()["total"] == 2
    assert sorted(r.id for r in C.read_comments(spark, d, multi_line=multi_line, bad="reject").select("id").collect()) == [1, 5]
    assert C.read_comments(spark, d, multi_line=multi_line, bad="only").select("id").count() == 3
