import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from ledgerlens.llm import language_id as L

PATH = public_tokenizers.path("piece_bpe_32k.model")
STOCK = {"en": "the of and to in is that for it with as was on be by this are from".split(), "de": "der die und das ist nicht ein mit auf für sich des dem im zu den".split()}


def text(lang, seed):
    r = random.Random(seed)
    return " ".join(r.choice(STOCK[lang]) for _ in range(r.randint(5, 60)))


def all_segmentations(word, ids, p):
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, min(len(word), L.PIECE) + 1):
        piece = ids.get(word[:k], 0 if k == 1 else None)
        if piece is not None:
            total += p[piece] * all_segmentations(word[k:], ids, p)
    return total


def test_forward_sums_all_segmentations_and_expected_counts_add_up():
    pieces = L.vocabulary(PATH)
    ids = {s: k + 1 for k, s in enumerate(pieces)}
    p = np.random.default_rng(1).random((len(ids) + 1, 2))
    p /= p.sum(0)
    words = ["the", "a", "überall", "漢字x", "zzzzqq", "information"]
    lattice = L.Lattice(words, ids)
    got = lattice.totals(p)
    for k, w in enumerate(words):
        for g in range(2):
            assert math.isclose(got[k, g], all_segmentations("▁" + w, ids, p[:, g]), rel_tol=1e-9)
    counts = lattice.expected(p[:, [0]], np.ones(len(words)))
    lengths = np.array([1] + [len(s) for s in pieces])
    assert math.isclose((counts * lengths).sum(), sum(len(w) + 1 for w in words), rel_tol=1e-9)


def test_predictions_on_held_out_rows(spark, make_docs):
    texts = [text(("en", "de")[k % 2], k) for k in range(120)] + [None, "", "12 34 !", "x" * 100_000, "der die das"]
    langs = [("en", "de")[k % 2] for k in range(120)] + ["en", "de", "en", None, None]
    at, docs = make_docs(texts, langs=langs)
    rows = {r.doc_id: r for r in L.op7_language_id(spark, at).collect()}
    assert len(rows) == len(texts)
    for k, r in rows.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1
        if k < 120:
            assert r.lang_pred == langs[k]
    assert [rows[k].lang_pred for k in (120, 121, 122)] == ["und"] * 3 and rows[124].lang_pred == "de"


def test_nothing_to_learn_and_empty_table(spark, make_docs):
    _, docs = make_docs(["1", None], langs=["en", None])
    assert L.learn(docs, PATH) is None
    assert {r.lang_pred for r in L.predict(docs, None).collect()} == {"und"}
    _, docs = make_docs(["some words", "andere Wörter"], langs=["en", "de"])
    assert L.predict(docs.limit(0), L.learn(docs, PATH)).count() == 0


@pytest.mark.parametrize("kept", [3, 50])
def test_words_are_forgotten(spark, make_docs, monkeypatch, kept):
    _, docs = make_docs([text("en", 1), text("de", 2)], langs=["en", "de"])
    model = L.learn(docs, PATH)
    texts = [text(("en", "de")[k % 2], k) for k in range(20)]
    whole = [model.text_scores([t])[0][0] for t in texts]
    monkeypatch.setattr(L, "KEPT", kept)
    assert np.allclose(whole, [model.text_scores([t])[0][0] for t in texts])
    assert np.allclose(whole, model.text_scores(texts)[0])


def test_words_are_runs_of_letters_and_their_marks():
    assert L.words_of("½ ² Ⅳ 12 _ \u0301") == [] and L.words_of("") == []
    assert L.words_of("Äpfel,हिन्दी 漢字x1y") == ["äpfel", "हिन्दी", "漢字x", "y"]
    *_, counts = L.word_places(["a b", "", "½ ²", "c"])
    assert counts.tolist() == [2, 0, 0, 1]


def test_letterless_texts_are_und(spark, make_docs):
    texts = ["the of and", "der die das"] * 3 + ["½ ²", "Ⅳ", "\u0301", "हिन्दी"]
    _, docs = make_docs(texts, langs=["en", "de"] * 5)
    rows = {r.doc_id: r for r in L.predict(docs, L.learn(docs, PATH)).collect()}
    assert [rows[k].lang_pred == "und" for k in range(10)] == [False] * 6 + [True] * 3 + [False]
    assert [rows[k].score for k in (6, 7, 8)] == [0.0] * 3


@pytest.mark.parametrize("stretch", [16, 17, 40, 1 << 13])
def test_long_words_are_summed_whole(monkeypatch, stretch):
    monkeypatch.setattr(L, "STRETCH", stretch)
    pieces = L.vocabulary(PATH)
    ids = {s: k + 1 for k, s in enumerate(pieces)}
    p = np.random.default_rng(2).random((len(ids) + 1, 2))
    p /= p.sum(0)
    r = random.Random(3)
    words = ["information" * 9 + "x", "".join(r.choice("etaoin漢字ü") for _ in range(100)), "a"]
    got = L.Lattice(words, ids).log_totals(L.with_none(p))
    for k, w in enumerate(words):
        w = "▁" + w
        for g in range(2):  # the same sums, place by place and in order
            sums = [0.0]
            for t in range(1, len(w) + 1):
                parts = [(i, ids.get(w[i:t], 0 if t - i == 1 else None)) for i in range(max(0, t - L.PIECE), t)]
                terms = [sums[i] + math.log(p[n, g]) for i, n in parts if n is not None]
                sums.append(max(terms) + math.log(sum(math.exp(x - max(terms)) for x in terms)))
            assert math.isclose(got[k, g], sums[-1], rel_tol=1e-9)
