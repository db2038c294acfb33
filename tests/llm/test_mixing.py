import itertools
import random
from collections import Counter

import pytest
from conftest import prose

from ledgerlens.llm import mixing as M


def test_targets():
    got = M.weighted_targets({"b": 10, None: 1000, "a": 500, "c": 0})
    assert list(sorted(got, key=lambda s: (s is None, s or ""))) == ["a", "b", "c", None]
    assert got["c"] == 0 and got["b"] == 30 and abs(sum(got.values()) - 1510) < 1e-6 and abs(got["a"] - got[None]) < 1e-6
    assert M.weighted_targets({"x": 0}) == {"x": 0.0} and M.weighted_targets({}) == {}


def cost(flow, patterns):
    """Each further use of a word costs one more than the one before."""
    total = 0
    for p, f in flow.items():
        n, use = sum(f.values()), 0
        while n > 0:
            total += use * min(n, patterns[p])
            n -= patterns[p]
            use += 1
    return total


def brute_flow(patterns, members, quotas, copies):
    best = None
    arcs = [(p, s) for p in patterns for s in members[p]]
    for amounts in itertools.product(*[range(min(quotas[s], copies * patterns[p]) + 1) for p, s in arcs]):
        out, into, flow = Counter(), Counter(), {p: {} for p in patterns}
        for (p, s), n in zip(arcs, amounts, strict=True):
            out[p] += n
            into[s] += n
            flow[p][s] = n
        if all(out[p] <= copies * patterns[p] for p in patterns) and all(into[s] <= quotas[s] for s in quotas):
            key = (-sum(amounts), cost(flow, patterns))
            best = key if best is None else min(best, key)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_the_cheapest(seed):
    r = random.Random(seed)
    sources = ["a", "b", "c"]
    patterns = {f"p{k}": r.randint(1, 3) for k in range(3)}
    members = {p: sorted(r.sample(sources, r.randint(1, 2))) for p in patterns}
    quotas = {s: r.randint(0, 5) for s in sources}
    flow = M.min_cost_flow(patterns, members, quotas, 2)
    assert (-sum(sum(f.values()) for f in flow.values()), cost(flow, patterns)) == brute_flow(patterns, members, quotas, 2)


def test_documents(spark, make_docs):
    r = random.Random(1)
    texts = [None, "", " a\tb ", "x " * 3000] + [prose(k, r.randint(1, 60)) for k in range(900)]
    sources = [None, "z", "z", "big"] + [r.choice(["big"] * 6 + ["s1", "s2", "ß", None]) for _ in range(900)]
    ids = [None, 1, 1, *range(3, len(texts))]
    at, docs = make_docs(texts, ids=ids, sources=sources)
    rows = M.mix_documents(docs).collect()
    sizes = Counter({s: 0 for s in set(sources)})
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len((t or "").split())
    targets = M.weighted_targets(dict(sizes))
    assert len(rows) == len(texts) and sum(x["size"] for x in rows) == sum(sizes.values())
    for s in sizes:
        mine = [x for x in rows if x.source == s]
        assert all(x.source_size == sizes[s] and abs(x.target - targets[s]) < 1e-6 and 0 <= x.taken <= 3 * x["size"] and x.taken == x.uses * x["size"] for x in mine)
        assert abs(sum(x.taken for x in mine) - targets[s]) <= 3
    again, once = M.op4_mixing(spark, at).collect(), [(x.doc_id, x["size"], x.source_size, x.target, x.taken) for x in rows]
    assert sorted(map(str, map(tuple, again))) == sorted(map(str, once))
    assert M.mix_documents(docs.limit(0)).count() == 0


def test_overlapping_sources_and_narrow_rounds(spark, monkeypatch):
    for name, value in (("BITS", 2), ("LAST", 4)):
        monkeypatch.setattr(M, name, value)
    r = random.Random(4)
    data = [(k, k, r.choice([["=a"], ["=b"], ["=b", "=a"], ["=c", "=a"]]), r.randint(0, 30)) for k in range(500)]
    rows = spark.createDataFrame(data, "uid long, doc_id long, members array<string>, size long")
    sizes = Counter()
    for _, _, m, n in data:
        sizes[tuple(sorted(m))] += n
    quotas = {"=a": 1500, "=b": 6000, "=c": 500}
    out = M.mix(rows, quotas).collect()
    flow = M.min_cost_flow({str(k): v for k, v in sizes.items()}, {str(k): list(k) for k in sizes}, quotas)
    for pattern, n in sizes.items():
        taken = sum(x["size"] * x.uses for x in out if tuple(sorted(x.members)) == pattern)
        assert abs(taken - sum(flow[str(pattern)].values())) <= 30


def test_one_id_on_many_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "LAST", 4)
    rows = spark.range(300).selectExpr("id as uid", "7L as doc_id", "array('=a') as members", "id % 5 as size")
    out = M.mix(rows, {"=a": 400}).collect()
    assert abs(sum(x["size"] * x.uses for x in out) - 400) <= 5 and max(x.uses for x in out) == 1
