"""Batch files (a JSON array of operations) and genesis files.

An operation may name an entity by $N, the key that the batch's N-th operation, a create, will make. Positions and
references are joined, so a batch may have any number of operations.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators.running import running
from .blocks import random_payload

ATTRIBUTE = "struct<name:string,string:string,uint:string,entityKey:string>"
OPERATION = f"array<struct<type:string,btl:long,entityKey:string,newOwner:string,contentType:string,payload:string,size:int,attributes:array<{ATTRIBUTE}>>>"


#: Operations in a span of running counts.
SPAN = 4096


class BatchError(ValueError):
    pass


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """position and the fields of each operation of a file; an empty file is an error."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", OPERATION)).alias("position", "o")).select("position", "o.*")
    if rows.isEmpty():
        raise BatchError("no operations")
    return rows


def with_nonces(ops: DataFrame, first_nonce: int, sender: str = "") -> DataFrame:
    """ops with nonce (creates only, in order) and made_key, the key that a create makes of its sender and nonce.

    Creates are counted by spans of positions, and spans by a small window, so no task has all operations.
    """
    create = F.coalesce(F.col("type") == "create", F.lit(False))
    rows = ops.withColumns({"_span": F.floor(F.col("position") / SPAN), "_all": F.lit(0)})
    rows = running(rows, "_all", "_span", ["position"], {"_nth": F.when(create, 1).otherwise(0)}, {})
    out = rows.withColumn("nonce", F.when(create, F.col("_nth") - 1 + first_nonce)).drop("_span", "_all", "_nth")
    return out.withColumn("made_key", F.when(F.col("nonce").isNotNull(), F.sha2(F.concat(F.lit(f"{sender}:"), F.col("nonce").cast("string")).cast("binary"), 256)))


def errors(ops: DataFrame) -> DataFrame:
    """ops with error: a field that is missing or two that exclude each other, a reference to no create; else null."""
    makes = ops.filter("made_key is not null").select(F.col("position").alias("_to"), F.col("made_key").alias("_key"))
    target = F.when(F.col("entityKey").rlike("^\\$[0-9]+$"), F.substring("entityKey", 2, 20).try_cast("int"))
    rows = ops.withColumn("_n", target).join(makes, F.col("_n") == F.col("_to"), "left")
    rows = rows.withColumn("target", F.coalesce("_key", F.lower(F.regexp_extract("entityKey", "^0x([0-9a-fA-F]{64})$", 1))))
    attribute = lambda a: sum((a[f].isNotNull().cast("int") for f in ("string", "uint", "entityKey")), F.lit(0)) != 1
    error = (
        F.when(~F.coalesce(F.col("type").isin(*codecs.OPERATIONS), F.lit(False)), F.lit("unknown type"))
        .when(F.col("type").isin("create", "extend") & F.col("btl").isNull(), F.lit("missing btl"))
        .when((F.col("type") != "create") & F.col("entityKey").isNull(), F.lit("missing entityKey"))
        .when((F.col("type") == "transfer") & F.col("newOwner").isNull(), F.lit("missing newOwner"))
        .when((F.col("type") != "create") & (F.coalesce("target", F.lit("")) == ""), F.lit("bad entityKey"))
        .when(codecs.batch_payload(F.col("payload"), F.col("size"))["error"].isNotNull(), codecs.batch_payload(F.col("payload"), F.col("size"))["error"])
        .when(F.exists(F.coalesce("attributes", F.array().cast(f"array<{ATTRIBUTE}>")), attribute), F.lit("attribute needs one value"))
    )
    return rows.withColumn("error", error).drop("_n", "_to", "_key")


def resolved(ops: DataFrame, block: int, seed: int = 0) -> DataFrame:
    """Operations as they are committed in a block: absolute expiry, default content type, sorted typed attributes.

    A size gives so many bytes that the seed and the operation's position make.
    """
    made = random_payload(F.col("size"), F.col("position"), seed)
    given = codecs.batch_payload(F.col("payload"), F.col("size"))["payload"]
    payload = F.when(F.col("size").isNotNull() & F.col("payload").isNull(), made).otherwise(given)
    typed = lambda a: F.struct(
        a["name"].alias("name"),
        F.when(a["string"].isNotNull(), F.lit("string")).when(a["uint"].isNotNull(), F.lit("uint")).otherwise(F.lit("entityKey")).alias("valueType"),
        F.coalesce(a["string"], a["uint"], F.regexp_replace(F.lower(a["entityKey"]), "^0x", "")).alias("value"),
    )
    kind = F.when(F.col("type").isin("create", "update"), F.coalesce("contentType", F.lit(codecs.DEFAULT_CONTENT_TYPE)))
    attributes = F.when(F.col("type").isin("create", "update"), codecs.sorted_attributes(F.transform(F.coalesce("attributes", F.array().cast(f"array<{ATTRIBUTE}>")), typed)))
    return errors(ops).select(
        "position", F.col("type").alias("op"), F.coalesce("made_key", "target").alias("entity_key"), F.when(F.col("btl").isNotNull(), F.col("btl") + block).alias("expires_at"), F.lower(F.regexp_replace("newOwner", "^0x", "")).alias("new_owner"),
        F.when(F.col("type").isin("create", "update"), payload).alias("payload"), kind.alias("content_type"), attributes.alias("attributes"), "error",
    )


def alloc_merge(old: DataFrame, new: DataFrame, key: str = "address", value: str = "account") -> DataFrame:
    """Accounts of both; a new one wins, and `replaced` says that it did."""
    joined = old.select(key, F.col(value).alias("_old")).join(new.select(key, F.col(value).alias("_new")), key, "full_outer")
    return joined.select(key, F.coalesce("_new", "_old").alias(value), (F.col("_old").isNotNull() & F.col("_new").isNotNull()).alias("replaced"))


def created(btl: int, payload: str | None = None, size: int | None = None, content_type: str | None = None, attributes: list[dict] | None = None) -> dict:
    """A create, as a batch file has it. Payload: text or 0x hex, or a size, or neither."""
    if payload is not None and size is not None:
        raise BatchError("payload and size")
    return _without_none({"type": "create", "btl": btl, "payload": payload, "size": size, "contentType": content_type, "attributes": attributes})


def updated(entity: str, payload: str | None = None, size: int | None = None, content_type: str | None = None, attributes: list[dict] | None = None) -> dict:
    return created(0, payload, size, content_type, attributes) | {"type": "update", "entityKey": entity, "btl": None}


def extended(entity: str, btl: int) -> dict:
    return {"type": "extend", "entityKey": entity, "btl": btl}


def transferred(entity: str, new_owner: str) -> dict:
    return {"type": "transfer", "entityKey": entity, "newOwner": new_owner}


def deleted(entity: str) -> dict:
    return {"type": "delete", "entityKey": entity}


def expired(entity: str) -> dict:
    return {"type": "expire", "entityKey": entity}


def _without_none(found: dict) -> dict:
    return {k: v for k, v in found.items() if v is not None}


def batch_rows(spark: SparkSession, ops: list[dict]) -> DataFrame:
    """Operations made here as read_batch gives them from a file."""
    if not ops:
        raise BatchError("no operations")
    value = json.dumps([_without_none(o) for o in ops])
    rows = spark.createDataFrame([(value,)], "value string")
    return rows.select(F.posexplode(F.from_json("value", OPERATION)).alias("position", "o")).select("position", "o.*")


def merge_genesis(genesis: dict, accounts: dict) -> dict:
    """A genesis file's object with accounts merged into alloc, by address; a chain id of 0 is refused."""
    if not genesis.get("config", {}).get("chainId"):
        raise BatchError("chainId is 0 or missing")
    return genesis | {"alloc": dict(sorted((genesis.get("alloc", {}) | accounts).items()))}
