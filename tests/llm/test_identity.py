"""What makes rows and texts the same: digests of rows with nulls, mixtures as multisets, fingerprints of swapped parts."""

from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from isopycna.llm import common, fingerprints, jaccard, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_digest_of_rows(spark):
    """Rows share a digest when they are equal, nulls in whichever column included."""
    rows = [*product([None, 1, 2], [None, "", "web", "x"], [None, "", "web"], [None, [None, 1], [1, None], [], [1]], [None, (None, "a"), ("a", None)])]
    df = spark.createDataFrame(rows + rows[:50], "i long, a string, b string, c array<int>, d struct<p:string,q:string>")
    got = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"), common.whole_row(df).alias("h")).distinct().collect()
    assert len(got) == len({x.h for x in got}) == len({x.row for x in got}) == len(rows)
    assert all(len(x.h) == 32 for x in got)


def shifted():
    """Rows that differ only in which columns are null."""
    words = "one two three four five six seven eight"
    return [
        (1, words, "web", None, 3),
        (1, words, None, "web", 3),
        (None, words, "web", None, 3),
        (None, words, None, "web", 3),
        (3, None, "a", None, None),
        (3, None, None, "a", None),
        (None, None, None, None, None),
        (None, None, None, None, None),
        (4, "", "b", None, 0),
        (4, "", None, "b", 0),
        (5, "another text of some words", None, None, None),
        (None, "another text of some words", None, None, 5),
    ]


def test_mixture_is_the_multiset_that_was_picked(spark):
    rows = shifted() * 2 + [(i, f"text number {i} " * (i % 7 + 1), None if i % 3 else "l", None if i % 4 == 0 else "s", None) for i in range(10, 60)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    key = common.whole_row(docs)
    picked = {r.h: r.n for r in mixing.mix(docs).groupBy(F.col("row_hash").alias("h")).agg(F.sum("copies").alias("n")).collect()}
    by_hash = {r.h: tuple(r)[:-1] for r in docs.select("*", key.alias("h")).collect()}
    assert len(by_hash) == len(set(rows))
    want = Counter({by_hash[h]: n for h, n in picked.items() if n})
    assert Counter(map(tuple, mixing.mixed(docs).collect())) == want
    # Nothing appears more often than twice its number of rows.
    many = Counter(rows)
    assert all(n <= 2 * many[r] for r, n in want.items())


def test_one_of_each_keeps_rows_apart(spark):
    docs = spark.createDataFrame(shifted(), SCHEMA)
    kept = Counter(map(tuple, jaccard.one_of_each(docs).collect()))
    assert sum(n for r, n in kept.items() if r[1] and r[1].startswith("one")) == 1
    assert sum(n for r, n in kept.items() if r[1] and r[1].startswith("another")) == 1
    # Rows without words all stay, each as often as it was there.
    assert {r: n for r, n in kept.items() if not r[1]} == Counter(r for r in shifted() if not r[1])


def test_pipeline_loses_no_row_to_nulls(spark, tmp_path):
    docs = spark.createDataFrame(shifted(), SCHEMA)
    assert set(map(tuple, corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect())) <= set(shifted())


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("pay Bob 10, pay Eve 90, ", "pay Eve 90, pay Bob 10, ", False),
        ("First. Second.", "Second. First.", False),
        ("x" * 24 + "y" * 24, "y" * 24 + "x" * 24, False),
        ("one\ntwo, three\nfour", "four\ntwo, three\none", True),
        ("one\ntwo\n", "two\none\n", True),
        ("one\n\ntwo", "one\ntwo\n", True),
        ("one", "one\n", False),
        ("one\ntwo", "one\n\ntwo", False),
        ("\n", "", False),
        ("\n", "\n\n", False),
        ("one two", "one  two", False),
        ("one\ntwo three", "one two\nthree", False),
        ("a\na\nb", "a\nb\nb", False),
    ],
)
def test_swapped_parts(spark, a, b, same):
    df = spark.createDataFrame([(0, a), (1, b), (1, b)], "i long, t string")
    fp = {r.i: r.fp for r in fingerprints.fingerprints(df, ["i"], F.col("t")).collect()}
    assert (fp[0] == fp[1]) == same
    likeness = spark.createDataFrame([(fp[0], fp[1])], "a array<int>, b array<int>").select(fingerprints.likeness(F.col("a"), F.col("b"))).first()[0]
    assert likeness == 1.0 if same else likeness <= 1.0
