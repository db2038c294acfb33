import random
import zlib

from conftest import prose

from ledgerlens.llm import toxicity as X

BAD = ["idiot", "moron", "loser", "worthless"]


def labelled(n):
    texts, marks = [], []
    for k in range(n):
        r, toxic = random.Random(k), k % 4 == 0
        words = prose(k, r.randint(5, 120)).split()
        if toxic:
            for w in r.sample(BAD, r.randint(1, 3)):
                words.insert(r.randint(0, len(words)), w)
        elif k % 10 == 1:
            words.insert(0, "worthless paper")  # harmless in this phrase
        texts.append(" ".join(words))
        marks.append(int(toxic))
    return texts, marks


def test_fold():
    assert X.fold("Id1ot") == X.fold("IDIOT") == X.fold("іdіоt") == X.fold("id!ot") == X.fold("ｉｄｉｏｔ") == X.fold("i​diot") == "idiot"
    assert X.fold("10s3r") == X.fold("loser") and X.fold("stupid!") == "stupid!"


def test_fold_of_marks_and_compatible_forms():
    for text in ("ídïot", "İDIOT", "i̇diot", "𝐢𝐝𝐢𝐨𝐭", "ⓘⓓⓘⓞⓣ", "ιδιοτ".replace("δ", "d"), "ıđıøŧ"):
        assert X.forms(text)[-1] == "idiot", text
    assert X.forms("fück") == ["fück", "fuck"] and X.forms("漢字 ß") == ["漢字 ß"] and X.forms("") == [""]
    a = X.Lexicon({"fuck": 3.0, "für": 1.0}, ()).automaton()
    assert X.features("fück", a) == X.features("fuck", a) and X.features("für fuck fück", a)[0] == X.math.log1p(1 + 2 * 3)


def plain_matches(folded, entries, exceptions):
    """The same by trying every entry at every place."""
    begins = lambda k: not k or not folded[k - 1].isalnum()
    ends = lambda k: k == len(folded) or not folded[k].isalnum()
    free = [(k, k + len(p)) for p in exceptions for k in range(len(folded)) if folded.startswith(p, k) and begins(k) and ends(k + len(p))]
    out = []
    for k in range(len(folded)):
        here = [e for e in entries if begins(k) and folded.startswith(e, k)]
        if here:
            e = max(here, key=len)
            if not any(a <= k and k + len(e) <= b for a, b in free):
                out.append((k, k + len(e), entries[e]))
    return out


def test_matches_against_brute_force():
    r = random.Random(8)
    for _ in range(300):
        word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 4)))
        entries = {word(): float(k + 1) for k in range(r.randint(1, 8))}
        exceptions = tuple({f"{word()} {word()}" for _ in range(r.randint(0, 5))} - set(entries))
        text = "".join(r.choice(["a", "b", "c", " ", " ", "-"]) for _ in range(r.randint(0, 60)))
        got = X.matches(text, X.Lexicon(entries, exceptions).automaton())
        assert sorted(got) == plain_matches(text, entries, exceptions)


def test_words_before_are_whole():
    long = "x" * 100
    assert X.word_before(f"a {long} idiot", 103) == f"{long} " and X.word_before("idiot", 0) == "" and X.word_before(" idiot", 1) == "" and X.word_before("a-idiot", 2) == ""


def test_matches_begin_words_and_miss_exceptions():
    a = X.Lexicon({"trash": 2.0, "tras": 1.0, "moron": 3.0}, ("trash can",)).automaton()
    assert X.matches("a trash can, trashy moronic oxymoron trash cans", a) == [(13, 18, 2.0), (20, 25, 3.0), (37, 42, 2.0)]
    assert X.matches("", a) == [] and X.matches("trash", X.Lexicon({}, ()).automaton()) == []


def test_held_out_rows(spark, make_docs):
    texts, marks = labelled(600)
    extra = [None, "", "you are an 1d1ot and a m0ron", "worthless paper " * 3, "x" * 200_000 + " idiot loser idiot"]
    at, docs = make_docs(texts + extra)
    labels = [(k, 1, m) for k, m in enumerate(marks)] + [(5, 1, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    rows = {r.doc_id: r for r in X.op5_toxicity(spark, at).collect()}
    assert len(rows) == len(texts) + len(extra)
    wrong = 0
    for k, r in rows.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        wrong += k < 600 and r.held_out and r.predicted != marks[k]
    assert wrong <= 4
    assert [rows[600 + k].predicted for k in range(5)] == [0, 0, 1, 0, 1]
    lexicon = X.learn(docs, spark.read.parquet(f"{at}/labels.parquet"))
    assert X.fold("worthless paper") in lexicon.exceptions and X.score(docs.limit(0), lexicon, "doc_id").count() == 0


def test_without_labels(spark, make_docs):
    _, docs = make_docs(["idiot", None])
    lexicon = X.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.toxicity < 0.7 for r in X.score(docs, lexicon, "doc_id").collect())
