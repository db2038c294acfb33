import hashlib
import random
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import bpe, bpe_codec

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "Hello  world's\n\n 'tis 12½² ok", "<|endoftext|>a<|endoftext|>", "<|endoftext", "漢字😀 é١٢ǅʰ́\x1c​᠎ x",
    " " * 3000 + "x", "a" * 9000, "the" * 3000, "-" * 2000 + "\n" * 900, "word " * 5000, "word " * 5000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Merges(bpe_codec.described(PATH)))


def flat(words):
    return [i for w in words for i in w]


def test_against_library(spark, make_docs, library):
    at, _ = make_docs(TEXTS)
    rows = bpe_codec.op10_bpe(spark, at).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        ids = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want and back == (TEXTS[r.doc_id] or "")


def test_empty_table_and_ids(spark, make_docs, library):
    _, docs = make_docs(TEXTS)
    assert bpe_codec.round_trip(docs.limit(0), PATH, "doc_id").count() == 0
    for r in bpe_codec.encode(docs, PATH, "doc_id").collect():
        assert r.token_ids == library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids


def test_streams_and_pieces(encoder, library):
    r, pool = random.Random(5), [*"  aabbcdeTh'sre!?.\n\t é漢😀½", "<|endoftext|>", "ing", "  "]
    for _ in range(400):
        text = "".join(r.choice(pool) for _ in range(r.randint(0, 60)))
        want = library.encode(text, add_special_tokens=False).ids
        assert flat(encoder.encode([text])[0]) == want
        stream, got, k = bpe.Stream(encoder), [], 0
        while k < len(text):
            step = r.randint(1, 9)
            got += stream.feed(text[k : k + step])
            k += step
        assert got + stream.finish() == want
        decoder = bpe.Decoder(encoder.merges)
        assert "".join(decoder.feed([i]) for i in want) + decoder.finish() == library.decode(want, skip_special_tokens=False)
    broken = [want for want in range(100, 400)]
    decoder = bpe.Decoder(encoder.merges)
    assert "".join(decoder.feed([i]) for i in broken) + decoder.finish() == library.decode(broken, skip_special_tokens=False)


def test_long_runs_need_bounded_memory(encoder, library):
    r = random.Random(6)
    for text in ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9000)), "".join(r.choice(["ing", "tion", "the", "on"]) for _ in range(3000))]:
        stream, got = bpe.Stream(encoder), []
        for k in range(0, len(text), 700):
            got += stream.feed(text[k : k + 700])
            held = len(stream.held) + (len(stream.run.buffer) if stream.run else 0)
            assert held <= 2 * encoder.merges.lookahead + 512 + 700
        assert got + stream.finish() == library.encode(text, add_special_tokens=False).ids


def test_words_are_forgotten(encoder, monkeypatch):
    monkeypatch.setattr(bpe.Encoder, "KEPT", 5)
    small = bpe.Encoder(encoder.merges)
    for text in ["a b c d", "e f g h i j k l", "a b c d"]:
        assert flat(small.encode([text])[0]) == flat(encoder.encode([text])[0])


def made_words(r, n, size):
    """n words of this size, no two alike but by chance, each with a space in front."""
    letters = r.choices("abcdefghijklmnopqrstuvwxyz", k=n * size)
    return "".join(" " + "".join(letters[k : k + size]) for k in range(0, n * size, size))


def test_what_an_encoder_keeps_has_few_bytes(encoder):
    r, fresh = random.Random(7), bpe.Encoder(encoder.merges)
    table = fresh.table
    for n, size in [(30_000, 7)] * 24 + [(1200, 200)] * 50:  # 720,000 words; 12 MB of long ones
        fresh.ids([made_words(r, n, size)])
        arrays = (table.low, table.high, table.row, fresh.pool, fresh.first, fresh.size)
        assert sum(a.nbytes for a in arrays) + sum(map(len, table.long)) < 50e6


def test_a_batch_of_long_texts_takes_little_memory(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe_codec.arrow, "map_texts", lambda rows, run, schema: run)

    class Docs:  # round_trip needs no more of a table to make its function
        schema, value = (), bpe_codec.described(PATH)
        sparkSession = sparkContext = property(lambda self: self)
        select = broadcast = lambda self, *_: self

    run = bpe_codec.round_trip(Docs(), PATH, "doc_id")
    r = random.Random(8)
    made = [made_words(r, 5000, 9) for _ in range(20)]
    texts = [*made, "".join(made), "a"]  # parts of a batch, and a part of a text
    batch = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts})
    list(run([batch.slice(0, 1)]))  # what is made once
    tracemalloc.start()
    got = pa.Table.from_batches(run([batch])).to_pylist()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for x, text in zip(got, texts, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert (x["doc_id"], x["n_tokens"], x["ids_sha256"]) == (texts.index(text), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert most < 60e6  # 138e6 when a part had a million characters


def test_memory_that_arrow_has_freed_goes_back(monkeypatch):
    released = []
    monkeypatch.setattr(bpe_codec.arrow.pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: released.append(1)})())
    bpe_codec.arrow.trim()
    assert released
