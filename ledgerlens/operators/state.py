"""Entity state from operations: the last writer of each group of fields, so no fold over rows in order.

Operations are rows with entity_key, op, block, position (their place in the block), sender, expires_at, new_owner and
event_id (what holds the payload). State at a block is state of the operations up to it, and a revert is state without
the reverted ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running

GONE = ("delete", "expire")
#: Blocks in a span of running values.
SPAN = 1024


def place() -> Column:
    """An operation's place on the chain."""
    return F.struct("block", "position")


def last_of(value: str, *ops: str) -> Column:
    return F.max_by(value, F.when(F.col("op").isin(*ops), place()))


def latest(ops: DataFrame) -> DataFrame:
    """One row for each entity that was ever created."""
    return ops.groupBy("entity_key").agg(
        F.min_by("sender", F.when(F.col("op") == "create", place())).alias("creator"),
        last_of("new_owner", "create", "transfer").alias("owner"),
        last_of("event_id", "create", "update").alias("payload_event"),
        last_of("expires_at", "create", "extend").alias("expires_at"),
        F.min(F.when(F.col("op") == "create", F.col("block"))).alias("created_block"),
        F.max(F.when(F.col("op") != "expire", F.col("block"))).alias("updated_block"),
        (~F.bool_or(F.col("op").isin(*GONE))).alias("alive"),
    )


def entities(ops: DataFrame) -> DataFrame:
    """latest, with the payload, content type and attributes that the last create or update gave. ops: with those columns."""
    content = F.max_by(F.struct("payload", "content_type", "attributes"), F.when(F.col("op").isin("create", "update"), place()))
    held = ops.groupBy("entity_key").agg(content.alias("content"))
    return latest(ops).drop("payload_event").join(held, "entity_key").select("*", "content.*").drop("content")


def as_of(ops: DataFrame, block: int) -> DataFrame:
    return latest(ops.filter(F.col("block") <= block))


def expirable(state: DataFrame, block: int) -> DataFrame:
    """Alive entities whose expiry isn't after the block."""
    return state.filter(F.col("alive") & (F.col("expires_at") <= block))


def versions(ops: DataFrame) -> DataFrame:
    """Every version of every entity: valid_from and valid_to (places; null: still), with owner, expiry and payload.

    A version ends where the entity's next operation is. Values are run along by spans of blocks, there and back, so an
    entity with very many operations is many tasks.
    """
    held = {"owner": ("new_owner", "create", "transfer"), "expires_at": ("expires_at", "create", "extend"), "payload_event": ("event_id", "create", "update")}
    own = {f"_own_{name}": F.when(F.col("op").isin(*kinds), F.col(value)) for name, (value, *kinds) in held.items()}
    rows = ops.select("entity_key", "op", "block", "position", place().alias("valid_from"), *[c.alias(k) for k, c in own.items()])
    rows = rows.withColumns({"_span": F.floor(F.col("block") / SPAN), "_back": -F.floor(F.col("block") / SPAN), "_block": -F.col("block"), "_position": -F.col("position")})
    rows = running(rows, "entity_key", "_span", ["block", "position"], {}, {f"_before_{name}": F.col(f"_own_{name}") for name in held})
    rows = running(rows, "entity_key", "_back", ["_block", "_position"], {}, {"valid_to": F.col("valid_from")})
    return rows.select("entity_key", "op", "valid_from", "valid_to", *[F.coalesce(f"_own_{name}", f"_before_{name}").alias(name) for name in held], (~F.col("op").isin(*GONE)).alias("alive"))


def monotonicity(ops: DataFrame) -> DataFrame:
    """Extends that don't raise their entity's expiry, with the expiry before."""
    rows = ops.withColumn("_span", F.floor(F.col("block") / SPAN))
    rows = running(rows, "entity_key", "_span", ["block", "position"], {}, {"before": F.when(F.col("op").isin("create", "extend"), F.col("expires_at"))}).drop("_span")
    return rows.filter((F.col("op") == "extend") & (F.col("expires_at") <= F.col("before")))
