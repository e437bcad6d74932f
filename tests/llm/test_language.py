"""Language identification against kernels counted in plain Python, held-out accuracy, and odd rows."""

import random
import unicodedata
import zlib

import numpy as np
import odd
import pytest

from zoneflow.llm import language

SYLLABLES = {
    "aa": ["ka", "ri", "to", "mo", "shi", "na"],
    "bb": ["the", "ing", "er", "on", "st", "ly"],
    "cc": ["ü", "sch", "ein", "ung", "heit", "ß"],
}


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2


def corpus(n=240, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 40))]
        text = " ".join(words)
        rows.append((i, text.upper() + "!!" if i % 7 == 0 else text, lang if i % 11 else None))
    return rows


def plain_grams(text):
    kind = [unicodedata.category(c)[0] for c in text.lower()]
    words = "".join(c if k in "LM" else " " for c, k in zip(text.lower(), kind, strict=True)).split()
    if not words:
        return set()
    spaced = " " + " ".join(words) + " "
    found = {spaced[i:i + n] for n in range(1, language.LENGTHS + 1) for i in range(len(spaced) - n + 1)}
    return found - {" "}


@pytest.mark.parametrize("text", ["", "a", " \t", "1234 !?", "Ab  c-d", "été ÉTÉ", "नमस्ते दुनिया", "x" * 50, "ß\n\nß"])
def test_grams_are_the_distinct_ones(text):
    assert len(language.grams(text)) == len(plain_grams(text))


def test_grams_of_a_long_text_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(t for _, t, _ in corpus(60))
    whole = language.grams(text)
    monkeypatch.setattr(language, "PIECE", 7)
    assert np.array_equal(language.grams(text), whole)
    assert len(whole) == len(plain_grams(text))


def test_equals_kernel_ridge_regression(spark):
    """With all training texts as landmarks the Nyström map is exact."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = [(t, g) for i, t, g in rows if g and not held(i)]
    model = language.fit_languages(docs, landmarks=3 * len(rows), ridge=1e-3)
    assert model.languages == sorted(SYLLABLES)
    sets = [plain_grams(t) for t, _ in learned]
    alike = lambda a, b: len(a & b) / max(1, len(a) * len(b)) ** 0.5
    kernel = np.array([[alike(a, b) for b in sets] for a in sets])
    target = np.array([[1.0 if g == lang else -1.0 for lang in model.languages] for _, g in learned])
    dual = np.linalg.solve(kernel + 1e-3 * len(sets) * np.eye(len(sets)), target)
    got = {r["doc_id"]: r for r in language.predict_languages(docs, model).collect()}
    right = 0
    for i, text, lang in rows:
        value = np.array([alike(plain_grams(text), s) for s in sets]) @ dual
        assert got[i]["lang_pred"] == model.languages[int(value.argmax())]
        assert got[i]["score"] == pytest.approx(min(1, max(0, (1 + value.max()) / 2)), abs=1e-3)
        assert got[i]["held_out"] == held(i)
        right += held(i) and lang == got[i]["lang_pred"]
    assert right >= 0.97 * sum(held(i) and lang is not None for i, _, lang in rows)


def test_held_out_rows_teach_nothing(spark):
    rows = corpus(120)
    turned = [(i, t, "zz" if held(i) else g) for i, t, g in rows]
    schema = "doc_id long, text string, lang string"
    models = [language.fit_languages(spark.createDataFrame(r, schema)) for r in (rows, turned)]
    assert models[1].languages == sorted(SYLLABLES)
    assert np.array_equal(models[0].weights, models[1].weights)


def test_a_rare_language_is_learned(spark):
    rows = [(i, t, g) for i, t, g in corpus(900) if g != "aa" or i % 20 == 0]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_languages(docs, max_rows=150)
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict_languages(docs, model).collect()}
    assert np.mean([got[i] == g for i, _, g in rows if g]) > 0.97


def test_odd_rows(spark):
    docs = odd.frame(spark)
    model = language.fit_languages(docs)
    assert model.languages == ["en"]
    got = language.predict_languages(docs, model)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    texts = sorted((r[0] is None, r[0], any(c.isalpha() for c in r[1] or "")) for r in odd.rows())
    said = sorted((r["doc_id"] is None, r["doc_id"], r["lang_pred"] != "und") for r in got.collect())
    assert [t[::2] for t in texts] == [t[::2] for t in said]
    assert all(r["score"] == 0 for r in got.collect() if r["lang_pred"] == "und")
    nothing = language.fit_languages(odd.empty(spark))
    assert nothing.languages == [] and language.predict_languages(odd.empty(spark), nothing).count() == 0
    unknown = language.predict_languages(docs, nothing).collect()
    assert len(unknown) == len(odd.rows()) and {(r["lang_pred"], r["score"]) for r in unknown} == {("und", 0.0)}


def test_very_long_text(spark):
    long = " ".join(t for _, t, g in corpus(400) if g == "bb") * 90
    docs = spark.createDataFrame([*corpus(90), (1000, long, None)], "doc_id long, text string, lang string")
    got = language.predict_languages(docs, language.fit_languages(docs)).filter("doc_id = 1000").first()
    assert len(long) > 1_000_000 and got["lang_pred"] == "bb"
