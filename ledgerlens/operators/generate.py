"""A workload of operations, as a function of a seed and an operation's number: the same for every partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs

#: Weights of operations, ranges of lifespans, of what an extension adds, and of payload sizes. Fixed values.
WEIGHTS = (("create", 4), ("update", 3), ("extend", 2), ("transfer", 1), ("delete", 1))
LIFESPAN, BUMP, PAYLOAD, SIGNERS, MOST_OPS = (30, 300), (50, 400), (64, 512), 10, 5


class WorkloadError(ValueError):
    pass


def draw(seed: int, number: Column, salt: str, low: int, high: int) -> Column:
    """A whole number from low up to, but not including, high."""
    return F.pmod(F.xxhash64(number, F.lit(seed), F.lit(salt)), F.lit(high - low)) + low


def picked(point: Column, weights=WEIGHTS) -> Column:
    """The kind in whose stretch of the running sum of weights the point (from 0) lies."""
    out, total = None, 0
    for kind, weight in weights:
        total += weight
        if weight:
            out = F.when(point < total, F.lit(kind)) if out is None else out.when(point < total, F.lit(kind))
    if not total:
        raise WorkloadError("all weights are zero")
    return out


def feasible(kind: Column, alive: Column, owned: Column, expired: Column, signers: int = SIGNERS, cap: int = 1000) -> Column:
    """Whether an operation can be done: creates below the cap, others with an entity owned, transfers with another signer."""
    return (
        F.when(kind == "create", alive < cap)
        .when(kind.isin("update", "extend", "delete"), owned > 0)
        .when(kind == "transfer", (owned > 0) & F.lit(signers >= 2))
        .when(kind == "expire", expired > 0)
        .otherwise(F.lit(False))
    )


def batches(spark: SparkSession, count: int, seed: int, weights=WEIGHTS, signers: int = SIGNERS, most: int = MOST_OPS) -> DataFrame:
    """batch, signer, op_index, op, lifespan or bump, payload size, content type and receiver of so many batches."""
    if most < 1 or not 1 <= signers <= 100:
        raise WorkloadError("at least one operation, and 1 to 100 signers")
    rows = spark.range(count).withColumnRenamed("id", "batch")
    rows = rows.withColumn("op_index", F.explode(F.sequence(F.lit(0), draw(seed, F.col("batch"), "size", 1, most + 1) - 1)))
    number, total = F.col("batch") * (most + 1) + F.col("op_index"), sum(w for _, w in weights)
    rows = rows.withColumns({"signer": F.pmod("batch", F.lit(signers)), "op": picked(draw(seed, number, "kind", 0, total), weights)})
    kind = F.element_at(F.array(*map(F.lit, codecs.CONTENT_TYPES)), draw(seed, number, "type", 1, 6).cast("int"))
    writes = F.col("op").isin("create", "update")
    return rows.withColumns(
        {
            "btl": F.when(F.col("op") == "create", draw(seed, number, "life", *LIFESPAN)).when(F.col("op") == "extend", draw(seed, number, "bump", *BUMP)),
            "size": F.when(writes, draw(seed, number, "size", *PAYLOAD)),
            "content_type": F.when(writes, kind),
            "receiver": F.when((F.col("op") == "transfer") & F.lit(signers > 1), F.pmod(F.col("signer") + draw(seed, number, "to", 1, max(2, signers)), F.lit(signers))),
        }
    )


def status(ops: DataFrame) -> DataFrame:
    """kind, sent, confirmed and failed of the kinds that were sent, in the order of reports. ops: op, confirmed."""
    order = F.element_at(F.create_map(*[F.lit(x) for k, n in enumerate(codecs.OPERATIONS) for x in (n, k)]), F.col("op"))
    return ops.groupBy("op").agg(F.count("*").alias("sent"), F.count_if("confirmed").alias("confirmed"), F.count_if(~F.col("confirmed")).alias("failed")).withColumn("place", order)


def tracked(ops: DataFrame, confirmed: Column) -> DataFrame:
    """What a load generator knows of its entities after all batches: those that failed change nothing.

    ops: block, position, op, entity, signer, receiver, expires_at. A create makes an entity of its signer, an extend moves its
    expiry, a transfer gives it away, a delete or an expire takes it. One row for each entity: owner, expires_at, alive.
    """
    good = ops.filter(confirmed)
    last = lambda value, *kinds: F.max_by(value, F.when(F.col("op").isin(*kinds), F.struct("block", "position")))
    good = good.withColumn("holder", F.when(F.col("op") == "create", F.col("signer")).otherwise(F.col("receiver")))
    return good.groupBy("entity").agg(last("holder", "create", "transfer").alias("owner"), last("expires_at", "create", "extend").alias("expires_at"), (~F.bool_or(F.col("op").isin("delete", "expire"))).alias("alive"))


def promoted(entities: DataFrame, block: int, pending: Column) -> DataFrame:
    """entities with queued: alive ones past their expiry that no batch in flight names, to be expired first."""
    return entities.withColumn("queued", F.col("alive") & (F.col("expires_at") <= block) & ~pending)


def chosen_kind(queued: Column, point: Column, weights=WEIGHTS) -> Column:
    """An expire if something is queued, else what the weights give."""
    return F.when(queued > 0, F.lit("expire")).otherwise(picked(point, weights))


def spam(spark: SparkSession, count: int, first_nonce: int, size: int = 256) -> DataFrame:
    """So many creates of one size, their nonces in a row."""
    return spark.range(count).select((F.col("id") + first_nonce).alias("nonce"), F.lit("create").alias("op"), F.lit(size).alias("size"))
