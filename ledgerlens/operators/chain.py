"""The canonical chain: headers with a rolling hash, continuity, commit, revert and reorg, and error codes.

A table of headers has number, hash, parent_hash, changeset_hash. The rolling hash of an operation is the digest of the
hash before, the entity's key and the entity's hash; an empty block has the hash of the block before.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digest import keccak256
from .running import carry_forward

#: Codes of errors on commit and revert. Fixed values.
PARENT_MISMATCH, BLOCK_NOT_FOUND, OUT_OF_ORDER, UNKNOWN_ENTITY, INTERNAL, CHANGESET_MISMATCH = -32001, -32002, -32003, -32004, -32005, -32006
#: The code of any other error of a read. Fixed value.
READ_ERROR = -32000
ZERO = "00" * 32
#: Blocks in a span of what is carried forward.
SPAN = 1024


class ChainError(ValueError):
    def __init__(self, code: int, message: str, data: dict | None = None):
        super().__init__(f"{code}: {message}")
        self.code, self.data = code, data or {}


def digest_hex(*parts: Column) -> Column:
    """SHA-256 of hex texts' bytes, one after another, as hex."""
    return F.sha2(F.unhex(F.concat(*parts)), 256)


def keccak_hex(*parts: Column) -> Column:
    """Keccak-256 of the same."""
    return F.lower(F.hex(keccak256(F.unhex(F.concat(*parts)))))


def sha_many(messages: list[bytes]) -> list[bytes]:
    return [hashlib.sha256(m).digest() for m in messages]


def rolling(ops: DataFrame, seed: Column, many=sha_many) -> DataFrame:
    """ops with previous and claimed: the rolling hash before and after each, from a seed for each block.

    many: the digests of many messages (sha_many, or keccak_many for Keccak-256). Blocks lie sorted in partitions and are
    read as they come; operations that stand at one place in their blocks are hashed together, and of a block that goes
    on in the next batch the hash is held, so a block of any size is no list.
    """
    rows = ops.select("block", "position", "entity_key", "entity_hash", seed.alias("seed"))

    def run(frames):
        held: dict[int, bytes] = {}
        for frame in frames:
            block, last = frame["block"].tolist(), {}
            nth = frame.groupby("block").cumcount().to_numpy()
            texts = [bytes.fromhex(k + h) for k, h in zip(frame["entity_key"], frame["entity_hash"], strict=True)]
            seeds, previous, claimed = frame["seed"].tolist(), [b""] * len(frame), [b""] * len(frame)
            order = np.argsort(nth, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(nth[order])) + 1) if len(order) else ():
                at = at.tolist()
                for k in at:
                    previous[k] = last.get(block[k]) or held.get(block[k]) or bytes.fromhex(seeds[k])
                for k, h in zip(at, many([previous[k] + texts[k] for k in at]), strict=True):
                    claimed[k] = last[block[k]] = h
            if block:
                held = {block[-1]: last[block[-1]]}
            yield frame[["block", "position"]].assign(previous=[x.hex() for x in previous], claimed=[x.hex() for x in claimed])

    made = rows.repartition("block").sortWithinPartitions("block", "position").mapInPandas(run, "block long, position long, previous string, claimed string")
    return ops.join(made, ["block", "position"])


def checked_links(ops: DataFrame, seed: Column, digest=digest_hex) -> DataFrame:
    """ops with expected, the digest of the hash before; the first of a block follows the block's seed.

    Every row is checked by the row before it in its block, so blocks are checked side by side.
    """
    w = Window.partitionBy("block").orderBy("position")
    before = F.coalesce(F.lag("claimed").over(w), seed)
    return ops.withColumn("_before", before).withColumn("expected", digest(F.col("_before"), F.col("entity_key"), F.col("entity_hash"))).drop("_before")


def broken_links(ops: DataFrame, seed: Column, digest=digest_hex) -> DataFrame:
    """Operations whose claimed hash isn't the digest of the one before."""
    return checked_links(ops, seed, digest).filter(F.col("expected") != F.col("claimed"))


def changeset_errors(blocks: DataFrame, ops: DataFrame, start: str, digest=digest_hex) -> DataFrame:
    """number, expected and got of headers and operations whose claimed rolling hash isn't what it must be.

    A header has the hash of its last operation, or of the header before it (start: of the one before all). An operation
    has the digest of the hash before, which is the header's before it for the first of a block. So nothing is folded.
    """
    before = links(blocks.select("number", F.col("changeset_hash").alias("hash")))
    before = before.select("number", F.col("hash").alias("got"), F.coalesce("before_hash", F.lit(start)).alias("seed"))
    last = ops.groupBy(F.col("block").alias("number")).agg(F.max_by("claimed", "position").alias("last"))
    headers_ = before.join(last, "number", "left").select("number", F.coalesce("last", "seed").alias("expected"), "got")
    each = checked_links(ops.join(before.select(F.col("number").alias("block"), "seed"), "block"), F.col("seed"), digest)
    rows = headers_.union(each.select(F.col("block").alias("number"), "expected", F.col("claimed").alias("got")))
    return rows.filter(~F.coalesce(F.col("expected") == F.col("got"), F.lit(False)))


def headers(blocks: DataFrame, span: int = SPAN) -> DataFrame:
    """blocks (number, last_hash: null where there are no operations) with changeset_hash carried forward."""
    out = carry_forward(blocks, "number", "last_hash", span)
    return out.withColumn("changeset_hash", F.coalesce("carried", F.lit(ZERO))).drop("carried")


def links(chain: DataFrame) -> DataFrame:
    """chain with the number and the hash of the block before by number."""
    span = chain.withColumn("_span", F.floor(F.col("number") / SPAN))
    # the first of a span looks at the last of those before it
    ends = span.groupBy("_span").agg(F.max_by(F.struct("number", "hash"), "number").alias("_end"))
    across = Window.orderBy("_span")
    ends = ends.select("_span", F.lag("_end").over(across).alias("_before"))
    w = Window.partitionBy("_span").orderBy("number")
    out = span.join(ends, "_span").withColumn("_last", F.coalesce(F.lag(F.struct("number", "hash")).over(w), F.col("_before")))
    return out.withColumns({"before_number": F.col("_last.number"), "before_hash": F.col("_last.hash")}).drop("_span", "_before", "_last")


def continuity_errors(chain: DataFrame) -> DataFrame:
    """number, code, expected and got of blocks that don't follow the block before."""
    rows = links(chain).filter("before_number is not null")
    code = F.when(F.col("number") != F.col("before_number") + 1, F.lit(OUT_OF_ORDER)).when(F.col("parent_hash") != F.col("before_hash"), F.lit(PARENT_MISMATCH))
    return rows.withColumn("code", code).filter("code is not null").select("number", "code", F.col("before_hash").alias("expected"), F.col("parent_hash").alias("got"))


def missing(references: DataFrame, chain: DataFrame) -> DataFrame:
    """References (number, hash) that aren't blocks of the chain."""
    return references.join(chain.select("number", "hash"), ["number", "hash"], "left_anti")


def revert(chain: DataFrame, references: DataFrame) -> DataFrame:
    return chain.join(references.select("number", "hash"), ["number", "hash"], "left_anti")


def commit(chain: DataFrame, blocks: DataFrame) -> DataFrame:
    return chain.unionByName(blocks.select(*chain.columns))


def reorg(chain: DataFrame, references: DataFrame, blocks: DataFrame) -> DataFrame:
    """Revert and commit in one: no state between them is seen, since nothing is published before the result."""
    return commit(revert(chain, references), blocks)
