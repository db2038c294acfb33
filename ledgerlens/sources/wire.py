"""Wire payloads of commits, reverts and reorgs, as JSON, to flat tables.

One superset struct reads all kinds of operations; absent fields are null. Empty blocks stay: they have a header and no
operations. Ids are hex text without 0x, numbers are longs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs

ATTRIBUTE = "struct<valueType:string,name:string,value:string>"
OPERATION = f"struct<type:string,opIndex:int,entityKey:string,owner:string,entityHash:string,changesetHash:string,expiresAt:string,payload:string,contentType:string,attributes:array<{ATTRIBUTE}>>"
TRANSACTION = f"struct<hash:string,index:int,sender:string,operations:array<{OPERATION}>>"
HEADER = "struct<number:string,hash:string,parentHash:string,changesetHash:string>"
BLOCK = f"struct<header:{HEADER},transactions:array<{TRANSACTION}>>"
REFERENCE = "struct<number:string,hash:string>"
#: Attributes with values as text, and the columns of operations that a store keeps of messages.
TYPED = "array<struct<name:string,valueType:string,value:string>>"
LEDGER_OPS = f"block long, block_hash string, position long, op string, entity_key string, sender string, expires_at long, new_owner string, event_id long, tx_hash string, entity_hash string, claimed string, payload binary, content_type string, attributes {TYPED}"
MESSAGE = f"blocks array<{BLOCK}>, newBlocks array<{BLOCK}>, revertedBlocks array<{REFERENCE}>"
VALUE_TYPES = ("uint", "string", "entityKey")


def plain(text: Column) -> Column:
    """Hex text in lower case without 0x."""
    return F.lower(F.when(text.startswith("0x"), F.substring(text, 3, 1 << 30)).otherwise(text))


def parse(messages: DataFrame, column: str = "value") -> DataFrame:
    """messages with `blocks` (committed, oldest first) and `reverted`; a message that can't be read has `malformed`."""
    read = messages.withColumn("_m", F.from_json(column, MESSAGE + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    out = read.withColumn("blocks", F.coalesce("_m.blocks", "_m.newBlocks", F.array().cast(f"array<{BLOCK}>"))).withColumn("reverted", F.coalesce("_m.revertedBlocks", F.array().cast(f"array<{REFERENCE}>")))
    return out.withColumn("malformed", F.col("_m").isNull() | F.col("_m._bad").isNotNull()).drop("_m")


def block_rows(parsed: DataFrame) -> DataFrame:
    """number, hash, parent_hash, changeset_hash, tx_count and transactions, a row for each committed block."""
    rows = parsed.select(F.explode("blocks").alias("b")).select("b.header.*", "b.transactions")
    return rows.select(codecs.parse_u64(F.col("number")).alias("number"), plain(F.col("hash")).alias("hash"), plain(F.col("parentHash")).alias("parent_hash"), plain(F.col("changesetHash")).alias("changeset_hash"), F.size(F.coalesce("transactions", F.array().cast(f"array<{TRANSACTION}>"))).alias("tx_count"), "transactions")


def header_rows(heads: DataFrame) -> DataFrame:
    """number, hash, parent_hash and changeset_hash of committed blocks, of which only the headers are there."""
    rows = heads.select(F.explode("headers").alias("h")).select("h.*")
    return rows.select(codecs.parse_u64(F.col("number")).alias("number"), plain(F.col("hash")).alias("hash"), plain(F.col("parentHash")).alias("parent_hash"), plain(F.col("changesetHash")).alias("changeset_hash"))


def reference_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.explode("reverted").alias("r")).select(codecs.parse_u64(F.col("r.number")).alias("number"), plain(F.col("r.hash")).alias("hash"))


def operation_rows(blocks: DataFrame) -> DataFrame:
    """A wide row for each operation; tx_index is the place among all transactions of the block."""
    rows = blocks.select(F.col("number").alias("block"), F.col("hash").alias("block_hash"), F.explode("transactions").alias("t"))
    rows = rows.select("block", "block_hash", F.col("t.index").alias("tx_index"), plain(F.col("t.hash")).alias("tx_hash"), plain(F.col("t.sender")).alias("sender"), F.explode("t.operations").alias("o"))
    return rows.select(
        "block", "block_hash", "tx_index", "tx_hash", "sender", F.col("o.opIndex").alias("op_index"), F.lower("o.type").alias("op"), plain(F.col("o.entityKey")).alias("entity_key"), plain(F.col("o.owner")).alias("owner"),
        plain(F.col("o.entityHash")).alias("entity_hash"), plain(F.col("o.changesetHash")).alias("changeset_hash"), codecs.parse_u64(F.col("o.expiresAt")).alias("expires_at"), plain(F.col("o.payload")).alias("payload"),
        F.col("o.contentType").alias("content_type"), F.col("o.attributes").alias("attributes"),
    )


def attribute_rows(ops: DataFrame) -> DataFrame:
    """entity_key, name, valueType and value (text of strings and numbers, hex of keys) of every operation's attributes."""
    rows = ops.select("block", "tx_index", "op_index", "entity_key", F.explode("attributes").alias("a"))
    return rows.select("block", "tx_index", "op_index", "entity_key", F.col("a.name").alias("name"), F.col("a.valueType").alias("valueType"), attribute_value(F.col("a")).alias("value"))


def attribute_value(a: Column) -> Column:
    """A wire attribute's value as text: strings and numbers as they are read, keys as hex."""
    raw = F.unhex(plain(a["value"]))
    return F.when(a["valueType"] == "string", codecs.container_string(raw)).when(a["valueType"] == "uint", codecs.word_text(F.unhex(F.lpad(F.hex(raw), 64, "0")))).otherwise(plain(a["value"]))


def ledger_ops(blocks: DataFrame) -> DataFrame:
    """The operations of blocks with all that a store keeps (LEDGER_OPS): owner, sender, payload, type and attributes too.

    A create's owner is the one it names, or its sender; a transfer names the new one; others leave it as it is.
    """
    typed = lambda a: F.struct(a["name"].alias("name"), a["valueType"].alias("valueType"), attribute_value(a).alias("value"))
    owner = F.when(F.col("op") == "create", F.coalesce("owner", "sender")).when(F.col("op") == "transfer", F.col("owner"))
    return operation_rows(blocks).select(
        "block", "block_hash", (F.shiftleft(F.col("tx_index").cast("long"), 32) + F.col("op_index")).alias("position"), "op", "entity_key", "sender", "expires_at", owner.alias("new_owner"), F.lit(None).cast("long").alias("event_id"),
        "tx_hash", "entity_hash", F.col("changeset_hash").alias("claimed"), F.unhex("payload").alias("payload"), "content_type", F.transform("attributes", typed).alias("attributes"),
    )


def transaction_error(operations: Column) -> Column:
    """Why a transaction as a whole is set aside: an unknown type, a name, content type or order that isn't valid; else null."""
    bad = lambda o: F.exists(F.coalesce(o["attributes"], F.array().cast(f"array<{ATTRIBUTE}>")), lambda a: ~F.coalesce(a["valueType"].isin(*VALUE_TYPES), F.lit(False)))
    names = lambda o: F.exists(F.coalesce(o["attributes"], F.array().cast(f"array<{ATTRIBUTE}>")), lambda a: ~codecs.valid_name(a["name"]))
    return (
        F.when(F.exists(operations, lambda o: ~F.coalesce(F.lower(o["type"]).isin(*codecs.OPERATIONS), F.lit(False))), F.lit("unknown operation"))
        .when(F.exists(operations, bad), F.lit("unknown value type"))
        .when(F.exists(operations, names), F.lit("bad attribute name"))
        .when(F.exists(operations, lambda o: o["contentType"].isNotNull() & ~codecs.valid_content_type(o["contentType"])), F.lit("bad content type"))
        .when(F.exists(operations, lambda o: o["attributes"].isNotNull() & ~codecs.strictly_sorted(o["attributes"])), F.lit("attributes out of order"))
    )


def quarantined(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks with good transactions only, bad transactions with their error); the chain goes on without the bad ones."""
    marked = F.transform("transactions", lambda t: F.struct(t.alias("t"), transaction_error(t["operations"]).alias("error")))
    rows = blocks.withColumn("_m", marked)
    good = rows.withColumn("transactions", F.transform(F.filter("_m", lambda m: m["error"].isNull()), lambda m: m["t"])).drop("_m")
    bad = rows.select("number", F.explode(F.filter("_m", lambda m: m["error"].isNotNull())).alias("m")).select("number", plain(F.col("m.t.hash")).alias("tx_hash"), "m.error")
    return good, bad


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """A message from each line of text files."""
    return spark.read.text(path)
