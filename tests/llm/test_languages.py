"""Language identification: kernels against sets of n-grams, regression against its normal equations, and held-out accuracy."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from isopycna.llm import languages

from . import oddities


def gram_set(text):
    """n-grams as the operator defines them, as byte strings."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in text.encode())
    return {raw[i : i + n] for n in range(1, languages.LONGEST + 1) for i in range(len(raw) - n + 1)}


def test_kernels_are_intersections(monkeypatch):
    monkeypatch.setattr(languages, "PIECE", 50)
    marks = ["The house is Green", "la maison est verte", "das Haus ist grün", "la maison est verte", "x"]
    texts = ["", "a house", "Maison; 42 grün", "z" * 500 + " la maison " + "ä" * 300, "日本語", "a", *marks] * 30
    column = pa.array([None, *texts]).slice(1)
    slots, bits, norms, root = languages.landmarks(pa.array(marks))
    model = languages.Model([], slots, bits, norms, root, np.zeros(0))
    got = languages.kernels(column, 3, len(texts), languages.places(slots), model.matrix())
    sets = [gram_set(m) for m in marks]
    assert len(slots) == len(set().union(*sets))
    for i, text in enumerate(texts[3:]):
        assert np.allclose(got[i], [len(gram_set(text) & s) / np.sqrt(len(s)) for s in sets], rtol=1e-5), text[:40]
    # In the mapped space the products of landmarks are their normalised kernels; copies add no dimension.
    phi = languages.mapped(languages.kernels(pa.array(marks), 0, 5, languages.places(slots), model.matrix()), root)[:, :-1]
    assert phi.shape[1] == 4
    want = [[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets]
    assert np.allclose(phi @ phi.T, want, atol=1e-5)


def test_ridge_minimises():
    dice = np.random.default_rng(3)
    phi = np.hstack([dice.normal(size=(60, 5)), np.ones((60, 1))])
    label = np.repeat([0, 1, 2], [40, 15, 5])
    w = languages.ridge(phi, label, 3, 0.1)
    weight = (1 / np.array([40, 15, 5]))[label] / 3

    def loss(x):
        return (weight[:, None] * (phi @ x - np.where(label[:, None] == np.arange(3), 1, -1)) ** 2).sum() + 0.1 * (x[:-1] ** 2).sum()

    assert all(loss(w) <= loss(w + 1e-3 * dice.normal(size=w.shape)) for _ in range(50))


def rows_of(spark, d):
    return {r.doc_id: r for r in languages.op11_languages(spark, d).collect()}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = rows_of(spark, d)
    assert got.keys() == truth.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 for r in got.values())
    held = [i for i, r in got.items() if r.held_out]
    for lang in ("en", "fr", "de", "es"):
        mine = [i for i in held if truth[i].lang == lang]
        assert np.mean([got[i].lang_pred == lang for i in mine]) >= 0.97, lang


def test_only_what_may_be_learnt_counts(spark, tmp_path):
    """Wrong languages of held-out rows, other sources and the order of rows change nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    a = rows_of(spark, oddities.stored(spark, tmp_path / "a", docs))
    changed = docs.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 4 = 2 then 'xx' else lang end lang", "'s' source", "n_chars").orderBy("text")
    assert rows_of(spark, oddities.stored(spark, tmp_path / "b", changed)) == a
    assert {r.lang_pred for r in a.values()} <= {"de", "en", "es", "fr"}


def test_odd_values(spark, tmp_path):
    rows = {r.doc_id: r for r in languages.op11_languages(spark, oddities.stored(spark, tmp_path, oddities.clashing(spark))).collect() if r.doc_id not in (1, None)}
    assert [(rows[i].lang_pred, rows[i].score) for i in (2, 3, 4)] == [("und", 0.0)] * 3
    assert {rows[i].lang_pred for i in (5, 6, 7, 8, 9, 10, -3)} <= {"en", "fr"}
    assert (rows[6].lang_pred, rows[6].score) == (rows[7].lang_pred, rows[7].score)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en"), (3, "12 34", "en"), (None, "text", "en")], "doc_id long, text string, lang string")
    assert languages.train(docs) is None
    assert {(r.lang_pred, r.score) for r in languages.identify(docs).collect()} == {("und", 0.0)}


def test_one_language_and_foreign_letters(spark):
    docs = spark.createDataFrame([(i, t, "") for i, t in enumerate(["un deux trois", "日本", "!!", "ab"] * 5)], "doc_id long, text string, lang string")
    got = languages.identify(docs).collect()
    assert {r.lang_pred for r in got} == {"", "und"}
    assert all((r.lang_pred == "und") == (docs_text == "!!") for r, docs_text in zip(sorted(got, key=lambda r: r.doc_id), ["un deux trois", "日本", "!!", "ab"] * 5))


@pytest.mark.parametrize("sample,per_lang", [(7, 500), (4000, 3)])
def test_sample_is_bounded_and_takes_turns(spark, sample, per_lang):
    rows = [(i, f"text number {chr(97 + i % 26)} {i}", "en" if i % 10 else "fr") for i in range(300)] + [(6, f"same id {i}", "en") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = languages.sample_rows(docs, per_lang=per_lang, sample=sample).collect()
    assert len(got) <= sample
    ids = {g.text: g for g in got}
    assert {g.lang for g in ids.values()} == {"en", "fr"}
