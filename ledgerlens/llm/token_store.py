"""A content-addressed store of token ids.

A document's ids are cut where a rolling hash of the last 16 of them meets a mask, so equal passages are cut alike
wherever they stand. A chunk is named by the SHA-256 of its ids as little-endian unsigned 32-bit integers, and stored
once, in the narrowest of 2 or 4 bytes that the vocabulary needs. Files of the store, all Parquet:

    chunks    key, n, payload
    recipes   rank, doc_id, start, n_tokens, keys, sizes, root    in ascending order of doc_id
    manifest  level, block, n, root                               a tree of 4096 children a node over the recipes' roots

A recipe's root is that of the binary Merkle tree of its chunks' names.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import arrow
from .bpe_codec import described, encoder_of, merges_of
from .shared import delete, documents, move, new_path, ranked, scratch

LEAST, MOST, MASK_BITS = 64, 4096, 9
FANOUT = 4096
PACKED = {"compression": "zstd"}
POLYNOMIAL = 0xEDB88320  # of CRC-32, reflected


def _gear(size: int) -> np.ndarray:
    """A fixed random number for each id."""
    x = (np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


def rolling(ids: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """At each id, the sum over it and the 15 before of their numbers, shifted by their distance."""
    h = gear[ids]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def cuts(ends: np.ndarray, lengths: list[int]) -> list[list[int]]:
    """For each document the ends of its chunks, from places (over all documents) where a chunk may end."""
    out, first = [], 0
    bounds = np.cumsum([0, *lengths])
    at = np.searchsorted(ends, bounds)
    for k, n in enumerate(lengths):
        begin, mine = 0, []
        for e in (ends[at[k] : at[k + 1]] - bounds[k]).tolist():
            while e - begin > MOST:
                begin += MOST
                mine.append(begin)
            if e - begin >= LEAST:
                mine.append(e)
                begin = e
        while n - begin > MOST:
            begin += MOST
            mine.append(begin)
        if begin < n:
            mine.append(n)
        out.append(mine)
    return out


def merkle(names: list[bytes]) -> bytes:
    """The root of a binary tree of SHA-256; a node without a sibling goes up as it is."""
    while len(names) > 1:
        pairs = [hashlib.sha256(a + b).digest() for a, b in zip(names[::2], names[1::2], strict=False)]
        names = pairs + names[len(names) - len(names) % 2 :]
    return names[0]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials (the highest bit is x to the 0) modulo the CRC's."""
    out, a = np.zeros_like(a), a.copy()
    for bit in range(31, -1, -1):
        out ^= np.where((b >> np.uint32(bit)) & np.uint32(1), a, np.uint32(0))
        a = (a >> np.uint32(1)) ^ np.where(a & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return out


@lru_cache(1)
def _shifts() -> list[list[np.ndarray]]:
    """For each power of two, what that many bytes behind it make of each byte of a CRC."""
    power, out = np.array([1 << 23], dtype=np.uint32), []  # x to the 8
    for _ in range(48):
        every = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
        out.append([_times(e, np.broadcast_to(power, 256)) for e in every])
        power = _times(power, power)
    return out


def shift_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32s as they count when so many bytes follow."""
    out, rest = crc.astype(np.uint32), n_bytes.astype(np.int64)
    for tables in _shifts():
        if not rest.any():
            break
        odd = np.flatnonzero(rest & 1)
        x = out[odd]
        out[odd] = tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]
        rest >>= 1
    return out.astype(np.int64)


def chunked(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """A row (table `recipes`) for every document, end_id after its ids, and one (table `chunks`) for each of its chunks.

    A task gives a chunk where it has it first. It holds the names that it has given, in proportion to the part of the
    input that it reads. place: of a chunk a part of its name, of a recipe a number of its own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(described(path))

    def run(batches):
        merges, encoder = merges_of(shared.value), encoder_of(shared.value)
        n = max(merges.size, end_id + 1)
        kind = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        gear = arrow.once(("gear", n), lambda: _gear(n))
        given: set[bytes] = set()
        row = TaskContext.get().partitionId() << 40
        for part, texts in arrow.slices(batches):
            ids, counts = encoder.ids(texts)
            ids = np.insert(ids, np.cumsum(counts), end_id)
            lengths = (counts + 1).tolist()
            narrow, wide = ids.astype(kind), ids.astype("<u4")
            ends = np.flatnonzero(rolling(ids, gear) >> np.uint32(32 - MASK_BITS) == 0) + 1
            keys, sizes, roots, begin = [], [], [], 0
            new: list[tuple[bytes, int, bytes]] = []
            for n_ids, mine in zip(lengths, cuts(ends, lengths), strict=True):
                edges = [begin, *(begin + e for e in mine)]
                names = []
                for a, b in zip(edges, edges[1:], strict=False):
                    names.append(hashlib.sha256(wide[a:b]).digest())
                    if names[-1] not in given:
                        given.add(names[-1])
                        new.append((names[-1], b - a, narrow[a:b].tobytes()))
                keys.append(names)
                sizes.append([b - a for a, b in zip(edges, edges[1:], strict=False)])
                roots.append(merkle(names))
                begin += n_ids
            recipes = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(lengths, pa.int64()), "keys": pa.array(keys, pa.list_(pa.binary())), "sizes": pa.array(sizes, pa.list_(pa.int32())), "root": pa.array(roots, pa.binary())}
            yield _padded("recipes", np.arange(row, row + len(lengths)), recipes, fields)
            row += len(lengths)
            if new:
                key, size, payload = zip(*new, strict=True)
                place = np.frombuffer(b"".join(k[:8] for k in key), dtype="<i8")
                yield _padded("chunks", place, {"key": pa.array(key, pa.binary()), "n": pa.array(size, pa.int32()), "payload": pa.array(payload, pa.binary())}, fields)

    rows = docs.select("doc_id", "text")
    fields = to_arrow_schema(StructType([docs.schema["doc_id"]]))
    fields = [pa.field("table", pa.string()), pa.field("place", pa.int64()), fields.field(0), *(pa.field(n, t) for n, t in PARTS.items())]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow.map_texts(rows, run, f"table string, place long, doc_id {kind}, n_tokens long, keys array<binary>, sizes array<int>, root binary, key binary, n int, payload binary")


PARTS = {"n_tokens": pa.int64(), "keys": pa.list_(pa.binary()), "sizes": pa.list_(pa.int32()), "root": pa.binary(), "key": pa.binary(), "n": pa.int32(), "payload": pa.binary()}


def _padded(table: str, place: np.ndarray, columns: dict[str, pa.Array], fields: list[pa.Field]) -> pa.RecordBatch:
    """Rows of one of the tables, with nulls in the columns of the other."""
    have = {"table": pa.array([table] * len(place)), "place": pa.array(place)} | columns
    return pa.RecordBatch.from_arrays([have[f.name] if f.name in have else pa.nulls(len(place), f.type) for f in fields], [f.name for f in fields])


def folded(nodes: DataFrame) -> DataFrame:
    """level, block, n and root of the nodes above those given (level, block, root)."""
    above = nodes.groupBy((F.col("level") + 1).alias("level"), F.floor(F.col("block") / FANOUT).alias("block")).agg(F.array_sort(F.collect_list(F.struct("block", "root"))).alias("c"))
    joined = F.aggregate("c", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["root"]))
    return above.select("level", "block", F.size("c").cast("long").alias("n"), F.unhex(F.sha2(joined, 256)).alias("root"))


class TokenStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        """One of the store's tables, its own columns only."""
        rows = self.spark.read.parquet(f"{self.path}/{name}")
        return rows.select("key", "n", "payload") if name == "chunks" else rows

    def write(self, docs: DataFrame, tokenizer: str, end_id: int) -> None:
        """Encodes docs and writes the store. A null text has the end id alone; repeated rows are documents of their own.

        Texts are encoded once, and chunks and recipes moved once: copies of a chunk meet after each task has left out
        its own, so a chunk that a third of all documents have is no hot key. Rows with one doc_id stand next to each
        other, in no fixed order; a null one stands before all. Texts are whole: a task holds the ids of the longest.
        Other columns of docs are not looked at. An empty table gives a store without rows.
        """
        made = f"{self.path}/made"
        rows = chunked(docs, tokenizer, end_id).repartition("place").dropDuplicates(["place", "key"])
        rows.drop("place").write.options(**PACKED).partitionBy("table").parquet(made)
        kept = self.spark.read.schema(rows.drop("place").schema).parquet(made)
        with scratch(self.spark):
            recipes = kept.filter("table = 'recipes'").select("doc_id", "n_tokens", "keys", "sizes", "root")
            recipes = ranked(recipes, ["doc_id"], "recipes", weight="n_tokens")
            recipes.select("rank", "doc_id", F.col("before").alias("start"), "n_tokens", "keys", "sizes", "root").write.parquet(f"{self.path}/recipes")
        if not move(self.spark, f"{made}/table=chunks", f"{self.path}/chunks"):
            kept.filter("table = 'chunks'").select("key", "n", "payload").write.parquet(f"{self.path}/chunks")  # there are none
        delete(self.spark, made)
        self._manifest()

    def _manifest(self) -> None:
        nodes, level = self.table("recipes").select(F.col("rank").alias("block"), "root"), 0
        while True:
            level += 1
            inner = folded(nodes.withColumn("level", F.lit(level - 1)))
            inner.write.mode("append").parquet(f"{self.path}/manifest")
            nodes = self.table("manifest").filter(F.col("level") == level).select("block", "root")
            if nodes.count() <= 1:
                return

    def chunk_digests(self) -> DataFrame:
        """key, n and crc of every stored chunk, computed from its payload."""

        def run(batches):
            for batch in batches:
                rows = []
                for payload, n in zip(batch.column("payload"), batch.column("n"), strict=True):
                    raw = payload.as_buffer()
                    wide = np.frombuffer(raw, dtype=f"<u{len(raw) // n.as_py()}").astype("<u4")
                    rows.append((hashlib.sha256(wide).digest(), len(wide), zlib.crc32(wide)))
                key, n, crc = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(n, pa.int32()), pa.array(crc, pa.int64())], ["key", "n", "crc"])

        return self.table("chunks").select("n", "payload").mapInArrow(run, "key binary, n int, crc long")

    def sound_recipes(self) -> DataFrame:
        """Recipes with sound: keys give the root, and sizes add up to n_tokens."""

        def run(batches):
            for batch in batches:
                rows = zip(*(batch.column(c).to_pylist() for c in ("keys", "sizes", "n_tokens", "root")), strict=True)
                sound = [bool(keys) and len(keys) == len(sizes) and sum(sizes) == n and merkle(keys) == root for keys, sizes, n, root in rows]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sound, pa.bool_())], [*batch.schema.names, "sound"])

        recipes = self.table("recipes")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in recipes.schema)
        return recipes.mapInArrow(run, f"{schema}, sound boolean")

    def listed(self) -> DataFrame:
        """block and listed: whether the manifest has the roots of the block's recipes, all of them and no others.

        A node above that isn't its children's, a top that isn't one, or a block whose recipes are all gone, and no
        block is listed.
        """
        manifest = self.table("manifest")
        made = folded(self.table("recipes").select(F.lit(0).alias("level"), F.col("rank").alias("block"), "root")).unionByName(folded(manifest.select("level", "block", "root")))
        made = made.select("level", "block", F.struct("n", "root").alias("made"))
        both = made.join(manifest.select("level", "block", F.struct("n", "root").alias("kept")), ["level", "block"], "full_outer")
        top = manifest.groupBy("level").count().agg(F.coalesce(F.max_by("count", "level"), F.lit(0)).alias("tops"), F.max("level").alias("top"))
        both = both.crossJoin(F.broadcast(top)).filter((F.col("level") <= F.coalesce("top", F.lit(1))))
        same = F.coalesce(F.col("made") == F.col("kept"), F.lit(False))
        wrong = both.agg(F.coalesce(F.bool_or((F.col("tops") != 1) | F.col("made").isNull() | ((F.col("level") > 1) & ~same)), F.lit(False)).alias("wrong"))
        return both.filter("level = 1").crossJoin(F.broadcast(wrong)).select("block", (same & ~F.col("wrong")).alias("listed"))

    def placed(self, recipes: DataFrame | None = None) -> DataFrame:
        """A row for each chunk in each recipe, with the ids that follow it in the document; one for a recipe without any."""
        recipes = self.table("recipes").withColumn("sound", F.lit(None).cast("boolean")) if recipes is None else recipes
        each = recipes.select("rank", "doc_id", "start", "n_tokens", "sound", F.posexplode_outer(F.arrays_zip("keys", "sizes")).alias("pos", "x"), "sizes")
        after = F.aggregate(F.slice("sizes", F.col("pos") + 2, F.size("sizes")), F.lit(0).cast("long"), lambda s, x: s + x)
        return each.select("rank", "doc_id", "start", "n_tokens", "sound", "pos", F.col("x.keys").alias("key"), F.col("x.sizes").alias("n"), F.coalesce(after, F.lit(0).cast("long")).alias("after"))

    def verified(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 and whole (every chunk is there, under its true name and size, the recipe
XX
        CRC-32 is linear: a document's is the exclusive or of its chunks', each shifted by the bytes behind it. So only
        digests of the stored chunks move, never their ids.
        """

        def run(batches):
            for batch in batches:
                crc = shift_crc(batch.column("crc").to_numpy(zero_copy_only=False), 4 * batch.column("after").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(crc, pa.int64())], [*keep, "crc"])

        keep = ["rank", "doc_id", "start", "has", "good"]
        found = self.chunk_digests().withColumnRenamed("n", "has")
        joined = self.placed(self.sound_recipes()).join(found, "key", "left")
        joined = joined.select("rank", "doc_id", "start", F.coalesce("has", F.lit(0)).cast("long").alias("has"), F.coalesce(F.col("sound") & (F.col("has") == F.col("n")), F.lit(False)).alias("good"), F.coalesce("crc", F.lit(0)).alias("crc"), "after")
        kind = self.table("recipes").schema["doc_id"].dataType.simpleString()
        shifted = joined.mapInArrow(run, f"rank long, doc_id {kind}, start long, has long, good boolean, crc long")
        out = shifted.groupBy("rank", "doc_id", "start").agg(F.sum("has").alias("n_tokens"), F.expr("bit_xor(crc)").alias("ids_crc32"), F.bool_and("good").alias("good"))
        out = out.withColumn("block", F.floor(F.col("rank") / FANOUT)).join(self.listed(), "block", "left")
        return out.select("doc_id", "start", "n_tokens", "ids_crc32", (F.col("good") & F.coalesce("listed", F.lit(False))).alias("whole"))

    def reconstruct(self) -> DataFrame:
        """rank, doc_id and payloads, the stored bytes of every document's chunks in order."""
        joined = self.placed().join(self.table("chunks").select("key", "payload"), "key")
        out = joined.groupBy("rank", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "payload"))).alias("x"))
        return out.select("rank", "doc_id", F.col("x.payload").alias("payloads"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a new store of all documents, id 2 after each, and reads it back; `whole` says that it is all there."""
    store = TokenStore(spark, new_path(spark, "token-store"))
    store.write(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2)
    return store.verified()
