import zlib
from collections import Counter

import numpy as np

from ledgerlens.llm import hilbert as H
from ledgerlens.llm import sharding as S


def test_curve_visits_neighbours():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * n)).reshape(n, -1).T
        at = H.hilbert_index(cells, bits)
        assert sorted(at) == list(range(1 << (bits * n)))
        walk = cells[np.argsort(at)].astype(int)
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_column_is_the_same_curve(spark):
    cells = np.random.default_rng(1).integers(0, 16, (200, 4))
    df = spark.createDataFrame([tuple(map(int, c)) for c in cells], "a int, b int, c int, d int")
    got = [r[0] for r in df.select(H.hilbert_column([df.a, df.b, df.c, df.d], 4)).collect()]
    assert got == list(H.hilbert_index(cells, 4).astype(int))


def test_counts_slots_and_values(spark, make_docs):
    texts = [None, "", "é", *["same"] * 30, *[f"text {k}" * (k % 9) for k in range(70)], "long " * 20_000]
    at, _ = make_docs(texts, ids=[None, 1, 1, *range(3, len(texts))])
    rows = S.op2_sharding(spark, at).collect()
    assert len(rows) == len(texts)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    for r in rows:
        if r.doc_id is not None and r.doc_id > 1:
            raw = (texts[r.doc_id] or "").encode()
            assert r["size"] == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in order] == sorted(r.hilbert for r in rows)
    again = S.op2_sharding(spark, at).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_bounds_of_shards_prune(spark, make_docs):
    n = 2400
    langs, sources = [["en"] * 6 + ["de", "fr", "es", None], [f"s{k}" for k in range(12)]][0], [f"s{k}" for k in range(12)]
    at, docs = make_docs(["w " * (1 + k * 7919 % 500) for k in range(n)], ids=[k * 7919 % n for k in range(n)], langs=[langs[k % 10] for k in range(n)], sources=[sources[k % 12] for k in range(n)])
    rows = S.shard_documents(docs).collect()
    held = lambda wanted: len({r.shard for r in rows if wanted(r)})
    # 24 shards are about two and a bit to a dimension, so one dimension leaves about half to two thirds of them
    assert all(held(lambda r, v=v: r.lang == v) <= 17 for v in ("de", "fr", "es")) and all(held(lambda r, v=v: r.source == v) <= 17 for v in sources)
    assert held(lambda r: r["size"] > 900) <= 14 and held(lambda r: r.doc_id < 200) <= 14
    assert 0 < held(lambda r: r.lang == "de" and r["size"] > 900) <= 10 and 0 < held(lambda r: r.lang == "de" and r.source == "s2" and r.doc_id < 1200) <= 6


def test_few_rows_and_none(spark, make_docs):
    at, docs = make_docs(["a", "b"])
    assert sorted((r.shard, r.slot) for r in S.op2_sharding(spark, at).collect()) == [(0, 0), (1, 0)]
    assert S.shard_documents(docs.limit(0)).count() == 0
