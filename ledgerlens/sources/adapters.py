"""Ledger tables made of the star schema's tables, the same on every run and for every partitioning.

An event is an operation of its user, in a block of ten minutes; a document is an entity with attributes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators.running import running

GENESIS_TIME, BLOCK_SECONDS = 1_704_067_200, 600
#: Blocks in a bucket of running values.
BUCKET = 144
#: Event types as operations. Fixed values.
OPERATION_OF = {"signup": "create", "purchase": "update", "view": "extend", "click": "transfer", "error": "delete"}


#: In tables that have one number for a chain place, at most so many transactions a block, and operations a transaction.
PACKED = 1024


def place_in_block(tx_index: str = "tx_index", op_index: str = "op_index") -> Column:
    """One number for both indices: each is an int, so 32 bits hold any."""
    return F.shiftleft(F.col(tx_index).cast("long"), 32) + F.col(op_index).cast("long")


def indices(position: Column) -> tuple[Column, Column]:
    """tx_index and op_index of a place in a block."""
    return F.shiftright(position, 32), position.bitwiseAND(F.lit((1 << 32) - 1))


def packed(block: Column, *at: Column) -> Column:
    """block and an index or two as one number of fixed width; an error where an index doesn't fit."""
    out = block
    for k in at:
        wrong = F.raise_error(F.concat(F.lit(f"an index of {PACKED} or more in block "), block.cast("string")))
        out = out * PACKED + F.when(k >= PACKED, wrong.cast("long")).otherwise(k)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, sender, op, block, amount (the event's value, rounded down) and at (microseconds since the first block)."""
    op = F.create_map(*[F.lit(x) for pair in OPERATION_OF.items() for x in pair])
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("sender"), F.element_at(op, F.col("event_type")).alias("op"), F.floor("value").cast("long").alias("amount"), at.alias("at"))
    return rows.withColumn("block", F.expr(f"at div {BLOCK_SECONDS * 1_000_000}"))


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations of all transactions: a transaction is what one sender does in one block.

    tx_index counts transactions of a block by their first event, op_index operations of a transaction in time. An
    entity lives from a create of its sender to the next; its key is the hash of the sender and the creates before.
    valid: a create, or the entity is there. position orders the operations of a block, (block, position) all of the chain.
    """
    rows = events(spark, sf_dir).withColumn("bucket", F.expr(f"block div {BUCKET}"))
    life = F.when(F.col("op").isin("create", "delete"), F.col("op"))
    rows = running(rows, "sender", "bucket", ["at", "event_id"], {"generation": F.when(F.col("op") == "create", 1).otherwise(0)}, {"life": life})
    rows = rows.repartition("block")  # for all windows below: those over a sender's part of a block lie in the same partition
    rows = rows.withColumns(
        {
            "valid": (F.col("op") == "create") | F.coalesce(F.col("life") == "create", F.lit(False)),
            "entity_key": F.sha2(F.concat_ws(":", F.col("sender").cast("string"), (F.col("generation") - 1).cast("string")).cast("binary"), 256),
            "_first": F.expr("min(struct(at, event_id)) over (partition by block, sender)"),
        }
    )
    rows = rows.withColumns(
        {
            "tx_index": F.expr("dense_rank() over (partition by block order by _first) - 1").cast("long"),
            "op_index": F.expr("row_number() over (partition by block, sender order by at, event_id) - 1").cast("long"),
        }
    )
    rows = rows.withColumns(
        {
            "position": place_in_block(),
            "expires_at": F.when(F.col("op").isin("create", "extend"), F.col("block") + F.col("amount")),
            "new_owner": F.when(F.col("op") == "create", F.col("sender")).when(F.col("op") == "transfer", F.expr("sender + 1 + amount % 5")),
            "entity_hash": F.sha2(F.concat(F.lit("event:"), F.col("event_id").cast("string")).cast("binary"), 256),
        }
    )
    return rows.select("event_id", "block", "tx_index", "op_index", "position", "sender", "op", "entity_key", "generation", "amount", "expires_at", "new_owner", "entity_hash", "valid")


OPLOG_SQL = f"""
e AS (
  SELECT event_id, user_id AS sender, floor(value)::BIGINT AS amount, epoch_us(ts) - {GENESIS_TIME}000000 AS at_us,
    CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'update' WHEN 'view' THEN 'extend' WHEN 'click' THEN 'transfer' WHEN 'error' THEN 'delete' END AS op
  FROM events),
e1 AS (SELECT *, at_us // {BLOCK_SECONDS}000000 AS block, sum(CASE WHEN op = 'create' THEN 1 ELSE 0 END) OVER (PARTITION BY sender ORDER BY at_us, event_id)::BIGINT AS generation FROM e),
e2 AS (
  SELECT *, op = 'create' OR (generation > 0 AND coalesce(sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY sender, generation ORDER BY at_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0) AS valid,
    min((at_us, event_id)) OVER (PARTITION BY block, sender) AS first_at
  FROM e1),
e3 AS (
  SELECT *, dense_rank() OVER (PARTITION BY block ORDER BY first_at) - 1 AS tx_index, row_number() OVER (PARTITION BY block, sender ORDER BY at_us, event_id) - 1 AS op_index FROM e2),
oplog AS (
  SELECT event_id, block, tx_index, op_index, block * 1048576 + tx_index * 1024 + op_index AS position, sender, op, sha256(sender || ':' || (generation - 1)) AS entity_key, generation, amount,
    CASE WHEN op IN ('create', 'extend') THEN block + amount END AS expires_at,
    CASE op WHEN 'create' THEN sender WHEN 'transfer' THEN sender + 1 + amount % 5 END AS new_owner, sha256('event:' || event_id) AS entity_hash, valid
  FROM e3)"""


def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of documents: key, owner, contentType, payload, expiresAt and attributes (name, valueType, value as text)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    key = lambda i: F.sha2(F.concat(F.lit("doc:"), i.cast("string")).cast("binary"), 256)
    kind = F.element_at(F.array(*[F.lit(c) for c in codecs.CONTENT_TYPES]), F.pmod(F.col("doc_id"), F.lit(5)).cast("int") + 1)
    one = lambda name, kind, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("name"), F.lit(kind).alias("valueType"), value.cast("string").alias("value")))
    attributes = F.array(
        one("lang", "string", F.col("lang")),
        one("linked.to", "entityKey", F.when(F.col("doc_id") > 0, key(F.col("doc_id") - 1))),
        one("n_chars", "uint", F.col("n_chars")),
        one("quality", "uint", F.col("quality")),
        one("source", "string", F.col("source")),
    )
    rows = docs.join(labels, "doc_id", "left")
    return rows.select(
        key(F.col("doc_id")).alias("key"), F.sha2(F.col("source").cast("binary"), 256).substr(1, 40).alias("owner"), kind.alias("contentType"), F.col("text").alias("payload"),
        (F.col("doc_id") + F.col("n_chars")).alias("expiresAt"), F.filter(attributes, lambda a: a.isNotNull()).alias("attributes"),
    )


ENTITIES_SQL = f"""
docs AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, sha256('doc:' || d.doc_id) AS key, sha256(source)[1:40] AS owner,
    [{', '.join(repr(c) for c in codecs.CONTENT_TYPES)}][(d.doc_id % 5 + 1)::INT] AS "contentType", d.text AS payload, d.doc_id + d.n_chars AS "expiresAt",
    CASE WHEN d.doc_id > 0 THEN sha256('doc:' || (d.doc_id - 1)) END AS linked
  FROM documents d LEFT JOIN labels l USING (doc_id)),
attributes AS (
  SELECT key, 'lang' AS name, 'string' AS "valueType", lang AS value FROM docs WHERE lang IS NOT NULL
  UNION ALL SELECT key, 'linked.to', 'entityKey', linked FROM docs WHERE linked IS NOT NULL
  UNION ALL SELECT key, 'n_chars', 'uint', n_chars::VARCHAR FROM docs WHERE n_chars IS NOT NULL
  UNION ALL SELECT key, 'quality', 'uint', quality::VARCHAR FROM docs WHERE quality IS NOT NULL
  UNION ALL SELECT key, 'source', 'string', source FROM docs WHERE source IS NOT NULL)"""
