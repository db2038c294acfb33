"""What sinks write: log lines of blocks, transactions and operations, events as text, results as JSON, and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_line(kind: Column, key: Column, owner: Column, expires_at: Column, entity_hash: Column, payload_size: Column, attributes: Column) -> Column:
    """A line for an operation: each kind shows its own fields. Attributes are counted for creates only, hashes shown for creates and updates."""
    part = lambda name, value: F.concat(F.lit(f" {name}="), F.coalesce(value.cast("string"), F.lit("-")))
    head = F.concat(F.upper(kind), part("key", key), part("owner", owner))
    writes = F.concat(part("payload", payload_size), part("hash", entity_hash))
    return (
        F.when(kind == "create", F.concat(head, part("expires", expires_at), writes, part("attributes", attributes)))
        .when(kind == "update", F.concat(head, writes))
        .when(kind == "extend", F.concat(head, part("expires", expires_at)))
        .otherwise(head)
    )


def block_lines(ops: DataFrame) -> DataFrame:
    """block, tx_count and op_count of the blocks that have operations; the log leaves empty ones out."""
    return ops.groupBy("block").agg(F.countDistinct("tx_index").alias("tx_count"), F.count("*").alias("op_count"))


def result_report(result: DataFrame, block: int, fields: tuple[str, ...] = ("key", "contentType", "expiresAt", "owner"), whole: bool = False) -> DataFrame:
    """One row: the count and the block of a query's result, which itself stays a table; whole: with its fields as an
    array in the order of keys, for results that are a page."""
    entities = [F.array_sort(F.collect_list(F.struct(*fields))).alias("entities")] if whole else []
    return result.agg(F.count("*").alias("count"), *entities).withColumn("block", F.lit(block).cast("long"))


def order_free_digest(rows: DataFrame, *columns: str) -> DataFrame:
    """digest: the sum, modulo 2**60, of the first 15 hex digits of each row's SHA-256. Any order of rows gives the same;
    it says whether two states are equal, and is no state root."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    part = F.conv(F.sha2(text.cast("binary"), 256).substr(1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg((F.coalesce(F.sum(part), F.lit(0)).cast("decimal(38,0)") % F.lit(1 << 60)).cast("long").alias("digest"))


def unwrapped(responses: DataFrame) -> DataFrame:
    """id, result and error of JSON-RPC responses (column value): an error wins, and no result is an error."""
    read = F.from_json("value", "id long, result string, error struct<code:int,message:string>")
    rows = responses.select(read.alias("r"))
    error = F.when(F.col("r.error").isNotNull(), F.concat_ws(": ", F.col("r.error.code").cast("string"), "r.error.message")).when(F.col("r.result").isNull(), F.lit("no result"))
    return rows.select("r.id", F.when(error.isNull(), F.col("r.result")).alias("result"), error.alias("error"))


def camel(df: DataFrame) -> DataFrame:
    """df with names as they are on the wire: parts after an underscore begin with a capital."""
    parts = {c: c.split("_") for c in df.columns}
    return df.withColumnsRenamed({c: p[0] + "".join(x[:1].upper() + x[1:] for x in p[1:]) for c, p in parts.items()})


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, over what is there."""
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)
