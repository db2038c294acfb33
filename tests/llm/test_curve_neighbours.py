import numpy as np

from ledgerlens.llm import curve_neighbours as N

SCHEMA = "vec_id long, embedding array<float>, label int, uid long, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 5, 7) for i, v in rows], SCHEMA)


def brute(rows, k=10):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for a, (i, x) in enumerate(good):
        if i % 100 == 0:
            d = sorted((float(np.sqrt(((x - y) ** 2).sum())), j) for b, (j, y) in enumerate(good) if b != a)
            out[i] = d[:k]
    return out


def test_recall_and_scores(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((6000, 16)).astype(np.float32)
    x[3000:3500] = x[:500] + 0.01
    rows = [(k, x[k].tolist()) for k in range(6000)]
    want, got = brute(rows), {}
    for q in N.neighbours(table(spark, rows), N.F.col("vec_id") % 100 == 0).collect():
        got.setdefault(q.query_id, []).append((q["rank"], q.vec_id, q.score))
    assert set(got) == set(want)
    hits = 0
    for i, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        for _, j, score in found:
            assert j != i and abs(score - np.sqrt(((x[i].astype(float) - x[j]) ** 2).sum())) < 1e-9
        hits += len({f[1] for f in found} & {j for _, j in want[i]})
    assert hits >= 0.9 * 10 * len(want)


def test_doubles_are_not_narrowed(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0 + 1e-9, 2.0]), (2, [1.0, 2.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(q.vec_id, q.score) for q in N.neighbours(df, N.F.col("vec_id") == 0).orderBy("rank").collect()]
    assert [i for i, _ in got] == [1, 2] and abs(got[0][1] - 1e-9) < 1e-15


def grouped(n, seed=3, dims=32):
    r = np.random.default_rng(seed)
    return (r.standard_normal((n // 100, dims))[r.integers(0, n // 100, n)] * 10 + r.standard_normal((n, dims)) * 0.1).astype(np.float32)


def test_answers_are_whole_and_windows_alone_find_most(spark):
    x = grouped(3000)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    d = np.sqrt(((x[::100, None].astype(float) - x[None].astype(float)) ** 2).sum(2))
    d[np.arange(30), np.arange(0, 3000, 100)] = np.inf
    want = {100 * q: set(np.argsort(d[q], kind="stable")[:10].tolist()) for q in range(30)}
    for whole, least in ((True, 1.0), (False, 0.9)):
        got = {}
        for q in N.neighbours(df, N.F.col("vec_id") % 100 == 0, whole=whole).collect():
            got.setdefault(q.query_id, set()).add(q.vec_id)
        assert sum(len(got[q] & want[q]) for q in want) >= least * 300


def test_groups_leave_few_blocks_to_compare():
    x = grouped(50_000)
    key = N.fit(x[:2000].astype(float), 1).keys(x.astype(float), 0)
    order = np.argsort(key, kind="stable")
    queries = np.arange(0, 50_000, 100)
    reach = np.full(len(queries), 1.5)
    directions = np.linalg.qr(np.random.default_rng(1).standard_normal((32, 32)))[0][:, : N.SHADOW]
    asked = N.Asked(queries, x[queries].astype(float), reach, directions, 10)
    for at in range(0, 50_000, N.BLOCK):
        part = order[at : at + N.BLOCK]
        asked.look(part, part, x[part].astype(float))
    assert len(asked.found) == 10 * len(queries) and asked.tested < 0.35 * len(queries) * 50_000


def test_ties_and_odd_vectors(spark):
    r = np.random.default_rng(2)
    same = r.standard_normal(16).astype(np.float32).tolist()
    rows = [(k, same) for k in range(900)] + [(k, r.standard_normal(16).astype(np.float32).tolist()) for k in range(900, 1000)]
    rows += [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (1300, [float("inf")] + [1.0] * 15), (1400, [None] + [1.0] * 15), (1500, []), (1600, [1.0] * 3), (None, same), (1700, [-0.0] * 15 + [1.0]), (1701, [0.0] * 15 + [1.0])]
    got = {}
    for q in N.neighbours(table(spark, rows), N.F.col("vec_id") % 100 == 0).collect():
        got.setdefault(q.query_id, []).append((q["rank"], q.vec_id, round(q.score, 9)))
    want = brute(rows)
    assert set(got) == set(want) == {*range(0, 1000, 100), 1700}
    for i in want:
        assert [(s, j) for _, j, s in sorted(got[i])] == [(round(s, 9), j) for s, j in want[i]]


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 3.0]), (0, [5.0, 5.0])]
    got = sorted(tuple(q) for q in N.neighbours(table(spark, rows), N.F.col("vec_id") % 100 == 0).collect())
    assert [(a, b, c) for a, b, c, _ in got] == [(0, 1, 1), (0, 1, 1), (0, 2, 0), (0, 2, 0)]
    assert N.neighbours(table(spark, []), N.F.col("vec_id") % 100 == 0).count() == 0
    assert N.neighbours(table(spark, [(0, [1.0])]), N.F.col("vec_id") % 100 == 0).count() == 0
