import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import prose
from tokenizers import Tokenizer

from ledgerlens.llm import token_store as S

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    passage = prose(1, 1500)
    return [None, "", "a", passage, passage, prose(2, 300) + " " + passage, passage + " " + prose(3, 40), "x" * 30_000, "<|endoftext|>", "é😀"]


def test_reads_back_what_was_encoded(spark, make_docs, tmp_path):
    library, rows_in = Tokenizer.from_file(PATH), texts()
    ids_in = [5, 3, 9, 1, 0, 7, 2, 8, 8, 6]
    at, docs = make_docs(rows_in, ids=ids_in)
    want, start = [], 0
    for doc_id, text in sorted(zip(ids_in, rows_in, strict=True), key=lambda x: x[0]):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want.append((doc_id, len(ids), zlib.crc32(ids.tobytes())))
    rows = sorted(S.op8_token_store(spark, at).collect(), key=lambda r: (r.doc_id, r.start))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == sorted(want) and all(r.whole for r in rows)
    for r in rows:
        assert r.start == start
        start += r.n_tokens


def test_chunks_are_stored_once_and_losses_are_seen(spark, make_docs, tmp_path):
    rows_in = texts()
    _, docs = make_docs(rows_in)
    store = S.TokenStore(spark, str(tmp_path / "store"))
    store.write(docs, PATH, 2)
    chunks, recipes = store.table("chunks").collect(), store.table("recipes").collect()
    assert len({r["key"] for r in chunks}) == len(chunks) < sum(len(r["keys"]) for r in recipes)
    for r in recipes:
        assert r.root == S.merkle(list(r["keys"]))
    top = store.table("manifest").collect()
    assert len(top) == 1 and top[0].root == hashlib.sha256(b"".join(r.root for r in sorted(recipes, key=lambda r: r["rank"]))).digest()
    library = Tokenizer.from_file(PATH)
    for r in store.reconstruct().collect():
        assert np.frombuffer(b"".join(r.payloads), "<u2").tolist() == library.encode(rows_in[r.doc_id] or "", add_special_tokens=False).ids + [2]
    lost = chunks[0]["key"]
    store.table("chunks").filter(S.F.col("key") != S.F.lit(bytes(lost))).write.parquet(str(tmp_path / "less"))
    (tmp_path / "store" / "chunks").rename(tmp_path / "gone")
    (tmp_path / "less").rename(tmp_path / "store" / "chunks")
    spark.catalog.clearCache()
    bad = {r.doc_id for r in store.verified().collect() if not r.whole}
    assert bad == {r.doc_id for r in recipes if lost in r["keys"]}


def test_whole_needs_the_recipe_its_root_and_the_manifest(spark, make_docs, tmp_path):
    _, docs = make_docs(["a", "b", prose(4, 1500), "c"])
    store = S.TokenStore(spark, str(tmp_path / "store"))
    store.write(docs, PATH, 2)
    recipes = spark.createDataFrame(store.table("recipes").collect(), store.table("recipes").schema)

    def not_whole(name, rows):
        rows.write.parquet(str(tmp_path / "new"))
        (tmp_path / "store" / name).rename(tmp_path / f"old-{name}")
        (tmp_path / "new").rename(tmp_path / "store" / name)
        bad = {r.doc_id for r in store.verified().collect() if not r.whole}
        (tmp_path / "store" / name).rename(tmp_path / "new")
        (tmp_path / f"old-{name}").rename(tmp_path / "store" / name)
        (tmp_path / "new").rename(tmp_path / f"gone-{len(list(tmp_path.iterdir()))}")
        return bad

    keys = {r.doc_id: r["keys"] for r in recipes.collect()}
    of = lambda k: S.F.col("doc_id") == k
    exchanged = recipes.withColumn("keys", S.F.when(of(0), S.F.array(S.F.lit(bytes(keys[1][0])))).otherwise(S.F.col("keys")))
    dropped = recipes.withColumns({c: S.F.when(of(2), S.F.slice(c, 2, 1000)).otherwise(S.F.col(c)) for c in ("keys", "sizes")})
    assert not_whole("recipes", exchanged) == {0} and not_whole("recipes", dropped) == {2}
    assert not_whole("recipes", recipes.withColumn("n_tokens", S.F.col("n_tokens") + S.F.when(of(3), 1).otherwise(0))) == {3}
    assert not_whole("recipes", recipes.filter(~of(1))) == {0, 2, 3}
    assert not_whole("manifest", store.table("manifest").limit(0)) == {0, 1, 2, 3}
    assert all(r.whole for r in store.verified().collect())


def test_empty_table(spark, make_docs, tmp_path):
    _, docs = make_docs(["a"])
    store = S.TokenStore(spark, str(tmp_path / "store"))
    store.write(docs.limit(0), PATH, 2)
    assert store.verified().count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 4096, 100_003])
def test_shifted_crc(n):
    a, b = b"hello", bytes(range(256)) * (n // 256 + 1)
    assert S.shift_crc(np.array([zlib.crc32(a)]), np.array([n]))[0] ^ zlib.crc32(b[:n]) == zlib.crc32(a + b[:n])
