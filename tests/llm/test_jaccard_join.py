import random
import re

import numpy as np
import pytest
from conftest import prose

from ledgerlens.llm import components as C
from ledgerlens.llm import jaccard_join as J
from ledgerlens.llm import shingles as S
from ledgerlens.llm import signature_tree as T

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def expected(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted((str((i, len(s), least[find(k)] if s else i)) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))))


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(f"x{r.random()}" if r.random() < share else w for w in text.split(" "))


def family_texts():
    base, passage = prose(1, 200), prose(2, 60)
    texts = [None, "", " \n\t", "one", "ONE", "one two", "two one", "a b c d e", "A b c d e", "a b c d e f", "É é", "é é", "a b c d e f"]
    texts += [edited(base, k, 0.008 * (k % 6)) for k in range(40)]  # near copies, some out of reach of each other
    texts += [passage + " " + prose(100 + k, 1 + k % 25) for k in range(40)]  # mostly one passage
    texts += [prose(200 + k, 80) + " " + passage for k in range(20)]  # the passage among other words
    texts += [base] * 10 + [prose(300 + k, 100) for k in range(20)] + [prose(9, 20_000), prose(9, 20_000) + " end"]
    return texts


@pytest.mark.parametrize("sizes", [None, (3, 8, 4, 7), (2, 4, 100, 100)])
def test_against_all_pairs(spark, make_docs, monkeypatch, sizes):
    if sizes:
        for name, value in zip(("FEW", "BLOCK", "ASKING", "CROWD"), sizes, strict=True):
            monkeypatch.setattr(J, name, value)
    texts = family_texts()
    ids = [3 * k % 1000 for k in range(len(texts))]
    at, _ = make_docs(texts, ids=ids)
    got = [str((r.doc_id, r.n_shingles, r.component_id)) for r in J.op9_jaccard_join(spark, at).collect()]
    assert sorted(got) == expected(list(zip(ids, texts, strict=True)))


def test_documents_with_one_passage_are_no_crowd(spark, make_docs, monkeypatch):
    monkeypatch.setattr(J, "FEW", 4)
    stars = []

    def counted(dealt, met=J.met):
        found = J.materialize(met(dealt), "met")
        stars.append(found.filter(found.kind == J.STAR).count())
        return found

    monkeypatch.setattr(J, "met", counted)
    passage = prose(1, 200)
    texts = [prose(1000 + k, 200) + " " + passage for k in range(400)] + [prose(1000, 200) + " " + passage + " end"]
    _, docs = make_docs(texts)
    got = sorted((r.doc_id, r.component_id) for r in J.jaccard_components(docs).collect())
    assert got == [(k, k % 400) for k in range(401)]
    assert stars == [0]


def test_a_crowd_of_many_stars_is_not_compared_as_one(spark, make_docs, monkeypatch):
    """Passages that a few documents have, two in each document, chain all documents to one crowd, of which few are linked."""
    for name, value in (("FEW", 4), ("CROWD", 16), ("frequent", lambda rows: np.zeros(1 << (J.SLOT_BITS - 6), dtype=np.uint64))):
        monkeypatch.setattr(J, name, value)
    keys = []
    monkeypatch.setattr(J, "tree_links", lambda rows, by, links=J.tree_links: keys.append(("text" in rows.columns, rows.count())) or links(rows, by))
    passages = [prose(10 + k, 40, 3000) for k in range(61)]
    texts = [f"{passages[k // 6]} {prose(500 + k, 40, 3000)} {passages[k // 6 + 1]}" for k in range(360)]
    texts += [texts[7] + " end", "start " + texts[200]]
    _, docs = make_docs(texts)
    got = {r.doc_id: r.component_id for r in J.jaccard_components(docs).collect()}
    assert got == {k: k for k in range(360)} | {360: 7, 361: 200}
    assert sum(n for exact, n in keys if not exact) < 12 * len(texts)


def test_null_and_repeated_ids_and_empty_table(spark, make_docs):
    base = prose(5, 50)
    texts, ids = [base, base + " more", base, "other words that stand here alone", None], [None, 4, 4, 4, None]
    _, docs = make_docs(texts, ids=ids)
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in J.jaccard_components(docs).collect())
    assert got == sorted([str((None, 46, 4)), str((4, 47, 4)), str((4, 46, 4)), str((4, 2, 4)), str((None, 0, None))])
    assert J.jaccard_components(docs.limit(0)).count() == 0


def test_shingles_against_words():
    texts = [*(t or "" for t in family_texts()), "x" * 3_000_000, "a b\x85c d e f", "a b\x1cc d e f"]
    hashes, counts = S.shingle_sets(texts)
    assert counts.tolist() == [len(shingles(t)) for t in texts]
    by_hash, at = {}, 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        mine = {int(h) for h in hashes[at : at + n]}
        assert by_hash.setdefault(frozenset(shingles(t)), mine) == mine
        at += n
    assert len({h for s in by_hash.values() for h in s}) == len(set().union(*by_hash))


def test_tree_loses_no_pair():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 1 << 63, int(n)).astype(np.uint64)) for n in r.integers(1, 90, 60)]
    for k in range(100):
        s = sets[r.integers(0, 60)]
        sets.append(np.unique(np.concatenate([s[r.random(len(s)) > 0.1 * r.random()], r.integers(0, 1 << 63, 2).astype(np.uint64)])))
    marks = [T.bitmap(s, T.bits_for(len(s))) for s in sets]
    allowed = set()
    for tree, at, _ in T.trees(marks, np.array([len(s) for s in sets])):
        allowed |= {tuple(sorted((int(at[x]), int(at[y])))) for i, j in tree.pairs() for x, y in zip(i.tolist(), j.tolist(), strict=True)}
    for a in range(len(sets)):
        for b in range(a):
            if T.linked(sets[a], sets[b]):
                assert (b, a) in allowed
                assert T.may_link(marks[a], len(sets[a]), marks[b], len(sets[b]))


def test_components_of_a_path_and_a_hub(spark):
    edges = [(7919 * k % 10_007, 7919 * (k + 1) % 10_007) for k in range(60)] + [(-1, 20_000 + k) for k in range(50)] + [(5, 5)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 61 + 51 and len({got[7919 * k % 10_007] for k in range(61)}) == 1
    assert {got[20_000 + k] for k in range(50)} == {got[-1]} and len(set(got.values())) == 2
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0
