"""Repair in splits: the same rows as repair of the whole document, wherever it is cut."""

import random

import pytest

from assayer.operators import repair as R
from assayer.operators import splits as X

DOCS = {
    "plain": "k,example_text\n1,a\n2,b, c\n3\n",
    "two lines": 'k,example_text\n1,"a\nb, ""c"""\n\n2,"d\n\n\ne"\n3,f\n',
    "fenced": '\n \n```csv\nk,example_text\n1,"x\n```\ny"\n```\n\n',
    "never closed": 'k,t\n1,a\n2,"b\nc, d\n\n\n',
    "never closed, fenced": '```\nk,t\n2,"b\nc\n \n```\n\n',
    "blank": " \n\n",
    "fence alone": "```\n",
    "wrapped": '"k,text"\n"1, ""a"" b"\n2,c\n',
    "text first": 'example_text,k\na, b,1\n"c, d",2\ne (f, g), h,3\n',
    "quotes within cells": 'k,v\n1,ab"c\nd"e\n"1"x"\n2",3\n',
    "space": "k,v\n\x1c\n \n\x85\n1,\x0b\n",
    "header over two lines": '"k\nl",v\n1,2\n',
}


def as_lines(spark, docs, size, rng):
    """Cut after each `size` lines or, for none, anywhere; rows in no order."""
    rows = []
    for name, text in docs.items():
        split = 0
        for i, value in enumerate(R.plain_ends(text).split("\n")):
            split += (i % size == 0) if size else rng.random() < 0.5
            rows.append((name, split, i * 3, value))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc string, split long, at long, value string").repartition(3)


def got(spark, lines):
    out = {}
    for r in sorted(X.repaired_cells(X.records(lines)).collect(), key=lambda r: (r.doc, r.split, r.at)):
        out.setdefault(r.doc, []).append(r.cells)
    return out


@pytest.mark.parametrize("size", [1, 2, 0, 1000])
def test_any_split_gives_what_the_whole_does(spark, size):
    rng = random.Random(size)
    docs = dict(DOCS)
    for i in range(40):
        docs[f"random {i}"] = "".join(rng.choice(['"', ",", "\n", "a", " ", "(", ")", "\r\n", "\n```", '"k,t"', '""']) for _ in range(rng.randrange(60)))
    want = {d: rows for d, t in docs.items() if (rows := R.repaired_rows(t))}
    assert got(spark, as_lines(spark, docs, size, rng)) == want
    assert {"blank", "fence alone"}.isdisjoint(want) and len(want) > 30


def test_no_lines_and_null_lines(spark):
    none = spark.createDataFrame([], "doc string, split long, at long, value string")
    assert X.repaired_cells(X.records(none)).count() == 0
    rows = spark.createDataFrame([("d", 0, 0, None), ("d", 0, 1, "k,v"), ("d", 1, 0, None), ("d", 1, 1, "1,2")], none.schema)
    assert got(spark, rows) == {"d": [["k", "v"], ["1", "2"]]}


def test_a_file_in_many_splits(spark, tmp_path):
    """A file that Spark reads in pieces, with cells over line ends across the cuts."""
    text = "k,example_text\n" + "".join(f'{i},"line\n{"x" * (i % 37)}, more"\n' if i % 3 else f"{i},a, b{i}\n" for i in range(4000))
    (tmp_path / "big.csv").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = X.physical_lines(spark, str(tmp_path / "big.csv"))
        assert lines.select("split").distinct().count() > 10
        rows = [r.text for r in X.csv_rows(X.repaired_cells(X.records(lines))).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert "\n".join(rows) + "\n" == R.repair(text)
