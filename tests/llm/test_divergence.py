"""The divergence audit against a plain version that lays out every term for every group."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from isopycna.llm import divergence

from . import oddities

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def naive(rows, least=10, top=10):
    """Rows (text, lang, source) to the set of (lang, source, part, item, value, rank)."""
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(UPPER))
        counts[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = set()
    for (lang, source), own in counts.items():
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        v = len(kept)

        def shares(c):
            n = sum(c[t] for t in kept)
            return [1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * v) for t in kept]

        p = shares(own)
        others = [s for (g, s) in counts if g == lang]
        whole = shares(sum((counts[lang, s] for s in others), Counter()))
        far = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = [(-sum(map(far, p, shares(counts[lang, s]))), s.encode()) for s in others if s != source]
        terms = [(-far(x, q), t.encode()) for t, x, q in zip(kept, p, whole) if own[t] and x > q]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)}
    return out


def as_rows(df):
    return [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]


def test_against_all_terms(spark):
    dice = random.Random(5)
    names = [f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)] + ["éé", "Ünï", "日本", "😀", "\U0001f600x"]
    rows = []
    for i in range(400):
        lang, source = dice.choice(["en", "EN", None, "", "fr"]), dice.choice(["a", "b", "ä", "z", "", None, "\U0001f600", "a2"])
        words = [dice.choice(names[: 20 + 15 * (i % 8)]).title() for _ in range(dice.choice([0, 1, 5, 40, 300]))]
        rows.append((dice.choice([" ", ", ", "1"]).join(words) if i % 17 else None, lang, source))
    rows += rows[:50] + [("only here", "xx", "s"), ("", "yy", "s"), (None, "yy", "t"), ("x " * 70_000, "fr", "long")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(7)
    for least, top in ((10, 10), (1, 3), (40, 100), (1000, 10)):
        got = as_rows(divergence.divergence(docs, least=least, top=top))
        want = naive(rows, least, top)
        assert len(got) == len(set(got)) and set(got) == want, (least, top)
        assert any(r[2] == "pair" for r in want)


def test_big_counts_stay_exact(spark):
    """Counts beyond nine milliards, of which the product no longer fits 64 bits."""
    t = spark.createDataFrame([(10**13 + 7, 10**13 + 9, 3), (0, 5, 1), (10**15, 10**15, 1)], "c long, n long, v long")
    got = [r.p for r in t.select(divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()]
    assert got == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in [(10**13 + 7, 10**13 + 9, 3), (0, 5, 1), (10**15, 10**15, 1)]]


def test_odd_rows(spark, tmp_path):
    rows = [(r[1], r[2], r[3]) for r in oddities.ROWS]
    d = oddities.stored(spark, tmp_path, oddities.clashing(spark))
    got = as_rows(divergence.op12_divergence(spark, d))
    assert set(got) == naive(rows) and len(got) == len(set(got))
    assert {r[:2] for r in got} == {("en", s) for s in ("a", "b", "c", "", "z", "ä")} and {r[4] for r in got} == {0}
    assert set(as_rows(divergence.divergence(oddities.odd(spark), least=1))) == naive(rows, 1)


@pytest.mark.parametrize("sent", [0, 100_000])
def test_groups_of_any_number(spark, monkeypatch, sent):
    """Whether the table of groups is sent to all executors or joined by exchange, rows are the same."""
    monkeypatch.setattr(divergence, "SENT", sent)
    rows = [(f"w{chr(97 + i % 5)} common", "en", f"s{i % 30}") for i in range(90)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert set(as_rows(divergence.divergence(docs))) == naive(rows)


def test_hot_source_is_dealt_out(spark):
    """Before rows of a source meet in one task, all but the highest of each task are gone."""
    docs = spark.createDataFrame([("a b", "en", "s")] * 3, "text string, lang string, source string")
    plan = divergence.divergence(docs, least=1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
