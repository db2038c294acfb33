import hashlib
import re

from ledgerlens.llm import secret_scans as S

PATTERNS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]
KEY = "AKIA" + "Q7" * 8
TEXTS = [
    None, "", " ", "password=hunter22 and Token: 'abc' then API_KEY = \"abcdef\"", "é😀 passwd:abcdefgh" + "a1" * 14, KEY + KEY, "password=token=abc secret: token: abcdef",
    "x" * 50_000 + " secret=" + "Z" * 40, "deadbeef" * 3, "deadbeef" * 3, "password= token:'secret1'", KEY[:19], "\nsecret\n=abcdefgh", "token  =  =abcdef",
    " ".join(f"apikey={k:08d}" for k in range(300)), "ſecret=abcdefg toKen=abcdefg",
]


def expected(text):
    text = text or ""
    found = sorted((m.start(), k, m.end()) for k, (_, p, good) in enumerate(PATTERNS) for m in p.finditer(text) if good(m))
    return ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in found)


def test_against_brute_force(spark, make_docs):
    at, _ = make_docs(TEXTS, ids=[None, *range(1, len(TEXTS))])
    rows = S.op1_secret_scans(spark, at).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        want = expected(TEXTS[r.doc_id or 0])
        assert r.spans == want and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [len(re.findall(k, want)) for k in ("assign", "access", "hex")]


def test_only_unseen_pairs_are_scanned(spark, make_docs, tmp_path):
    _, docs = make_docs(TEXTS)
    ledger = S.Ledger(spark, str(tmp_path / "ledger"))
    first = ledger.scan(docs).count()
    blobs = len({t or "" for t in TEXTS})
    assert first == 3 * blobs
    assert S.scan_unseen(docs, ledger.read()).count() == 0
    _, more = make_docs([*TEXTS, "new token=abcdefgh"])
    assert S.scan_unseen(more, ledger.read()).count() == 3
    changed = (S.RULES[0], S.RULES[1], S.Rule("hex", "2", r"[0-9a-f]{30,}"))
    assert {r.rule for r in S.scan_unseen(docs, ledger.read(), changed).collect()} == {"hex@2"}
    rows = S.secrets(docs, ledger, changed).collect()
    assert len(rows) == len(TEXTS) and ledger.read().count() == first + blobs


def test_two_writers_on_one_ledger_give_each_finding_once(spark, make_docs, tmp_path):
    _, docs = make_docs(TEXTS)
    ledger = S.Ledger(spark, str(tmp_path / "ledger"))
    plans = [S.scan_unseen(docs, ledger.read()) for _ in range(2)]
    for plan in plans:  # both were made before either was written
        plan.write.mode("append").parquet(ledger.path)
    assert ledger.read().count() == 2 * 3 * len({t or "" for t in TEXTS})
    got = {r.doc_id: r.spans for r in S._digests(S.secrets(docs, ledger)).collect()}
    assert got == {k: expected(t) for k, t in enumerate(TEXTS)}


def test_empty_table_and_redaction(spark, make_docs):
    at, docs = make_docs(["a"])
    empty = docs.limit(0)
    assert S.secrets(empty, S.Ledger(spark, at + "/ledger")).count() == 0
    _, docs = make_docs(["x password=hunter22 y " + "ab" * 12, "clean", "token=" + "ab" * 12])
    rows = S.secrets(docs, S.Ledger(spark, at + "/ledger2"), keep=("doc_id", "text"))
    got = {r.doc_id: r.t for r in rows.select("doc_id", S.redact(rows.text, rows.found).alias("t")).collect()}
    assert got == {0: "x [REDACTED] y [REDACTED]", 1: "clean", 2: "[REDACTED]"}
