import random
from collections import Counter, defaultdict

import pytest
from conftest import prose
from test_jaccard_join import expected, shingles
from test_mixing import M
from test_secret_scans import KEY, PATTERNS

import corpus_pipeline as P
from ledgerlens.llm import jaccard_join as J

BAD = ["idiot", "moron", "loser", "worthless"]


def corpus():
    texts, labels = [], []
    for k in range(240):
        words = prose(k, 20 + k % 60).split()
        if k % 4 == 0:
            for w in random.Random(k).sample(BAD, 2):
                words.insert(3, w)
        labels.append((k, 1, int(k % 4 == 0)))
        texts.append(" ".join(words))
    texts += [texts[1]] * 5 + [texts[5] + " end", texts[5], "password=hunter22 " + prose(900, 30), KEY + " " + prose(901, 30) + " " + "ab" * 14, None, "", prose(905, 300)]
    return texts, labels


@pytest.fixture(scope="module")
def stages(spark, make_docs):
    texts, labels = corpus()
    at, docs = make_docs(texts, sources=[("big", "s1", "s2", None)[min(3, k % 7)] for k in range(len(texts))])
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        df = stage(spark, out[-1], at)
        path = f"{at}/{name.replace(' ', '-')}"
        df.write.parquet(path)
        out.append(spark.read.parquet(path))
    return at, out


def test_each_stage(spark, stages):
    at, (docs, clean, single, masked, mixed, coded) = stages
    texts, _ = corpus()
    for df in (clean, single, masked, mixed):
        assert df.columns == docs.columns and df.schema.simpleString() == docs.schema.simpleString()
    kept = {r.doc_id: r.text for r in clean.collect()}
    toxic = {k for k, t in enumerate(texts) if any(b in (t or "").split() for b in BAD)}
    assert set(range(len(texts))) - set(kept) == toxic and all(kept[k] == texts[k] for k in kept)

    groups = [eval(x) for x in expected(sorted(kept.items()))]
    one = {r.doc_id: r.text for r in single.collect()}
    assert set(one) == {i for i, _, c in groups if i == c} and single.count() == len(one)

    for r in masked.collect():
        text = one[r.doc_id]
        found = sorted((m.start(), m.end()) for _, p, good in PATTERNS for m in p.finditer(text or "") if good(m))
        if found:
            want, end = "", 0
            for a, b in found:
                want += (text[end:a] + "[REDACTED]") if a >= end else ""
                end = max(end, b)
            assert r.text == want + text[end:] and r.n_chars == len(r.text)
        else:
            assert r.text == text
    assert masked.count() == len(one) and masked.filter("text like '%[REDACTED]%'").count() == 2

    before, after, sizes = {r.doc_id: r for r in masked.collect()}, Counter(r.doc_id for r in mixed.collect()), defaultdict(int)
    taken = defaultdict(int)
    for i, r in before.items():
        n = len((r.text or "").split())
        sizes[r.source] += n
        taken[r.source] += n * after[i]
    targets = M.weighted_targets(dict(sizes))
    assert max(after.values()) <= 3 and all(abs(taken[s] - targets[s]) <= 60 for s in sizes)
    assert {r.doc_id: r.text for r in mixed.collect()}.items() <= {i: r.text for i, r in before.items()}.items()

    assert Counter(r.doc_id for r in coded.collect()) == after
    import hashlib

    for r in coded.collect():
        assert r.decoded_sha256 == hashlib.sha256((before[r.doc_id].text or "").encode()).hexdigest() and len(r.token_ids) == r.n_tokens


def test_run_is_the_stages(spark, stages):
    at, out = stages
    got = P.run(spark, at)
    assert Counter(map(str, got.collect())) == Counter(map(str, out[-1].collect()))


def test_copies_with_null_and_repeated_ids(spark, make_docs):
    base = prose(50, 40)
    _, docs = make_docs([base, base, base + " x", "other", None, None, prose(51, 20), prose(51, 20)], ids=[None, 4, 4, None, None, 7, None, None])
    got = P.drop_copies(spark, docs, "").collect()
    assert sorted((str(r.doc_id), len(shingles(r.text)) > 0) for r in got) == [("4", True), ("7", False), ("None", False), ("None", True), ("None", True)]


def test_documents_with_one_passage_are_not_compared(spark, make_docs, monkeypatch):
    monkeypatch.setattr(J, "FEW", 4)
    keys = []
    monkeypatch.setattr(J, "tree_links", lambda rows, by, links=J.tree_links: keys.append((by, rows.count())) or links(rows, by))
    passage = prose(1, 200)
    _, docs = make_docs([prose(1000 + k, 200) + " " + passage for k in range(300)] + [prose(1000, 200) + " " + passage + " end"])
    kept = P.drop_copies(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == list(range(300))
    assert keys == [(["component", "block"], 0), (["component", "block"], 2)]


def test_stage_2_leaves_no_shuffle_files_and_no_setting(spark, make_docs, monkeypatch):
    key, shuffles = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    monkeypatch.setattr(J, "components", lambda edges, real=J.components: shuffles.append(spark.conf.get(key)) or real(edges))
    old = spark.conf.get(key, "false")
    _, docs = make_docs([prose(k, 30) for k in range(20)] + [prose(3, 30)])
    assert P.drop_copies(spark, docs, "").count() == 20
    assert shuffles and set(shuffles) == {"true"} and spark.conf.get(key) == old


def test_stages_on_no_rows(spark, stages):
    at, out = stages
    for (_, stage), docs in zip(P.STAGES, out, strict=False):
        assert stage(spark, docs.limit(0), at).count() == 0


def test_columns_of_the_input_are_not_touched(spark, make_docs, stages):
    at, _ = stages
    base = prose(70, 40)
    _, docs = make_docs([base, base, "token=abcdefgh " + prose(71, 30), None], ids=[3, 1, 1, None])
    own = {"_id": "doc_id * 10", "_slot": "'slot'", "_word": "1.5", "marked": "doc_id is null", "_toxicity": "9", "_row": "array(1)", "_stays": "'x'", "found": "2", "blob_id": "3", "uses": "4", "uid": "5", "a b": "6"}
    docs = docs.drop("blob_id").selectExpr("*", *[f"{v} as `{k}`" for k, v in own.items()])
    shown = lambda df: sorted(str([r[c] for c in ("doc_id", *own)]) for r in df.collect())
    for name, stage in P.STAGES[:-1]:
        made = stage(spark, docs, at)
        assert made.columns == docs.columns, name
        assert set(shown(made)) <= set(shown(docs))
    assert P.drop_copies(spark, docs, at).count() == 3 and P.redact_secrets(spark, docs, at).filter("text like '[REDACTED]%'").count() == 1


def test_rows_that_share_an_id_are_rows_of_their_own(spark, make_docs):
    one, two, three = prose(60, 40), prose(61, 40), prose(62, 40)
    _, docs = make_docs([one, two, three, one, prose(63, 40), three], ids=[5, 5, 9, 2, (1 << 62) + 1, 9])
    got = P.drop_copies(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(2, one), (5, two), (9, three), ((1 << 62) + 1, prose(63, 40))])
