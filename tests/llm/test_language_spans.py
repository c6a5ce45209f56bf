"""Paths against trying all of them, held-out accuracy, and odd inputs."""

import itertools
import random
import zlib

import numpy as np
import pytest

from gridlens.llm import language_spans as ls


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(spark, docs):
    return ls.train(docs)


def test_held_out_accuracy(docs):
    rows = {r["doc_id"]: r for r in ls.op9_language_spans(docs).collect()}
    truth = {r["doc_id"]: r for r in docs.collect()}
    assert rows.keys() == truth.keys()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    tested = [i for i, r in rows.items() if r["held_out"] and truth[i]["lang"]]
    right = sum(rows[i]["lang_pred"] == truth[i]["lang"] for i in tested)
    assert len(tested) > 150 and right / len(tested) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_mixed_text_has_spans(spark, docs, model):
    texts = {r["lang"]: r["text"] for r in docs.where("n_chars between 800 and 3000").collect()}
    mixed = " ".join(" ".join(texts[lang].split(" ")[:60]) for lang in ("en", "de", "fr"))
    row = ls.predict(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    assert [s["lang"] for s in row["spans"]] == ["en", "de", "fr"]
    assert sum(s["words"] for s in row["spans"]) == len(ls.words_of(mixed))
    assert row["score"] < 0.6


def test_paths_against_all_paths():
    rng = np.random.default_rng(1)
    model = ls.Model(["a", "b", "c"], np.zeros((1, 3), np.float32), np.ones((1, 3), bool), 2.0)
    labeller = ls.Labeller(model)
    labeller.scores = rng.normal(0, 2, (50, 3)).astype(np.float32)
    texts = [rng.integers(0, 50, n) for n in (1, 2, 7, 5, 6, 7, 1, 1, 3, 3)]

    def value(rows, path):
        return sum(float(labeller.scores[r, p]) for r, p in zip(rows, path, strict=True)) - 2.0 * sum(map(int.__ne__, path, path[1:]))

    for rows, together in zip(texts, labeller._together(texts), strict=True):
        best = max(itertools.product(range(3), repeat=len(rows)), key=lambda p: value(rows, p))
        alone = labeller._alone(labeller.scores[rows].tolist())
        assert list(together) == list(alone) == list(best)
        one = labeller._one_language(labeller.scores[rows])
        assert one is None or list(one) == list(best)


def test_odd_texts(spark, model, monkeypatch):
    monkeypatch.setattr(ls, "KEPT_WORDS", 50)
    monkeypatch.setattr(ls, "GROUP_WORDS", 100)
    rng = random.Random(1)
    long = " ".join(rng.choice(["the", "and", "this", "that", "of"]) for _ in range(9000))
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 ½ !!", "x"), (4, "漢字かな", "x"), (None, "the and this that", "x"), (6, long, "x"), (6, long, "x")]
    got = ls.predict(spark.createDataFrame(rows, "doc_id long, text string, SCORE string"), model).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and {by_id[i]["lang_pred"] for i in (1, 2, 3)} == {"und"}
    assert by_id[4]["lang_pred"] in model.languages and by_id[4]["score"] == 0
    assert by_id[None]["lang_pred"] == by_id[6]["lang_pred"] == "en" and by_id[6]["spans"][0]["words"] == 9000


def test_scripts_narrow(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("привет мир слово", "ru"), ("hello world word", "en"), ("γεια κοσμε λογος", "el")] * 20)]
    model = ls.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = ls.predict(spark.createDataFrame([(1, "мир hello hello hello"), (2, "ζζζ")], "doc_id long, text string"), model)
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[1]["lang_pred"] == "en" and [s["lang"] for s in by_id[1]["spans"]] == ["ru", "en"]
    assert by_id[2]["lang_pred"] == "el"


def test_nothing_to_learn(spark):
    schema = "doc_id long, text string, lang string"
    assert ls.op9_language_spans(spark.createDataFrame([], schema)).collect() == []
    (row,) = ls.op9_language_spans(spark.createDataFrame([(1, "the and", None)], schema)).collect()
    assert (row["lang_pred"], row["score"]) == ("und", 0.0)
