import random
import re
from collections import Counter

from conftest import prose

from ledgerlens.llm import quality_rules as Q


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    found, covered = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)), set()
    for k in range(len(w) - 4):
        if found[tuple(w[k : k + 5])] > 1:
            covered.update(range(k, k + 5))
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def shout(seed):
    return " ".join(w.upper() + "!!" for w in prose(seed, 60).split())


def stars(seed):
    r = random.Random(seed)
    return " ".join(w + r.choice(["***", "%%%", "&&"]) for w in prose(seed, 60).split())


EDGES = [
    None, "", " \n\t\x0b", "a", "a b c d", "a b c d e", "a " * 9, "a " * 40, "a b c d e f a b c d e f", "é b c d\x85e\x1cf", "x\nx\n\n \nx\r\nx", "#*$%&|<>",
    "a b c d e x a b c d e y b c d e x", prose(4, 30_000, 50), "word " * 20_000, "\n".join(["same line of text here"] * 30),
]


def test_counts_and_verdicts(spark, make_docs):
    good, bad = [prose(k, 20 + k % 90) for k in range(300)], [(shout, stars)[k % 2](k) for k in range(80)]
    texts = EDGES + good + bad
    at, docs = make_docs(texts, ids=[None, 1, 1, *range(3, len(texts))])
    labels = [(k, 1, 0) for k in range(len(EDGES), len(EDGES) + 200)] + [(len(EDGES) + 300 + k, 0, 0) for k in range(50)] + [(None, 0, 0), (7, None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    rows = Q.op3_quality_rules(spark, at).collect()
    assert len(rows) == len(texts)
    by_text = Counter(tuple(r)[1:7] for r in rows)
    assert by_text == Counter(brute(t) for t in texts)
    kept = {r.doc_id: r.kept for r in rows}
    assert all(kept[k] for k in range(len(EDGES), len(EDGES) + 300))
    assert sum(kept[k] for k in range(len(EDGES) + 300, len(texts))) <= 4
    assert not any(r.kept for r in rows if r.base_failed)
    rules = Q.learn(docs, spark.read.parquet(f"{at}/labels.parquet"))
    assert rules and all(len(rule) <= Q.TERMS for rule in rules) and all(str(t) for rule in rules for t in rule)
    assert Q.judged(docs.limit(0), rules, "doc_id").count() == 0


def test_nothing_to_learn(spark, make_docs):
    _, docs = make_docs([prose(1, 30)])
    assert Q.learn(docs, spark.createDataFrame([], "doc_id long, quality int")) == []
    assert [r.kept for r in Q.judged(docs, [], "doc_id").collect()] == [True]


def test_rules_cover_in_order():
    r = random.Random(2)
    rows = [{"s_a": r.random(), "s_b": r.random(), "part": k % 3 > 0} for k in range(900)]
    for x in rows:
        x["bad"] = int(x["s_a"] > 0.9 or (x["s_b"] < 0.2 and x["s_a"] < 0.3))
    rules = Q.cover(rows, ["s_a", "s_b"])
    wrong = sum(any(all(t.holds(x) for t in rule) for rule in rules) != bool(x["bad"]) for x in rows)
    assert 2 <= len(rules) and wrong < 40
