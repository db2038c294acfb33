"""Sharding along a Hilbert curve, in DataFrame functions only.

Several metadata dimensions are quantised, rows are sorted by their index on the curve, and the order is cut into runs
of equal counts. Rows near each other in all dimensions share a shard, so the bounds of each dimension prune shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hilbert import hilbert_column
from .shared import documents, ranked, scratch

BITS = 4


def category_cell(rows: DataFrame, name: str, bits: int = BITS) -> Column:
    """A value's place in the order of values, by the share of rows up to the middle of its own, so that cells hold equally many.

    The driver holds the most frequent values, one less than there are cells; all others and null come last.
    """
    cells = 1 << bits
    counts = rows.groupBy(name).count()
    total = counts.agg(F.sum("count")).first()[0] or 1
    most = counts.filter(F.col(name).isNotNull()).orderBy(F.desc("count"), name).limit(cells - 1).collect()
    cell, before = F.lit(cells - 1), 0
    for r in sorted(most, key=lambda r: r[name]):
        cell = F.when(F.col(name) == r[name], F.lit(int(cells * (before + r["count"] / 2) / total))).otherwise(cell)
        before += r["count"]
    return cell


def depth_cell(column: Column, cuts: list) -> Column:
    """How many of the cuts (ascending) a value is above; null is below all."""
    return sum((F.coalesce((column > cut).cast("int"), F.lit(0)) for cut in cuts), F.lit(0))


def range_cell(column: Column, low: Column, high: Column, bits: int = BITS) -> Column:
    """Equal steps between two bounds; null, or no width: 0."""
    at = F.floor((column.cast("double") - low) / F.nullif(high.cast("double") - low + 1, F.lit(0.0)) * (1 << bits))
    return F.coalesce(F.least(F.greatest(at, F.lit(0)), F.lit((1 << bits) - 1)), F.lit(0))


def curve_shards(rows: DataFrame, cells: list[Column], order: list[str], shards: int) -> DataFrame:
    """rows with hilbert, shard and slot: runs of the curve, counts at most one apart, slots from 0 without gaps.

    order: the columns that break ties on the curve; rows that tie in all of them go in the order they are read.
    No column of rows may be named hilbert, rank, total, shard or slot. A cell that holds a third of all rows is dealt
    over as many partitions as it fills, since the sort goes on by `order`. An empty table gives no rows.
    """
    placed = rows.withColumn("hilbert", hilbert_column(cells, BITS))
    out = ranked(placed, ["hilbert", *order], "curve")
    more, each = F.pmod("total", F.lit(shards)), F.floor(F.col("total") / shards)
    first = more * (each + 1)  # so many rows are in the shards that have one more
    shard = F.when(F.col("rank") < first, F.floor(F.col("rank") / (each + 1))).otherwise(more + F.floor((F.col("rank") - first) / F.nullif(each, F.lit(0))))
    out = out.withColumn("shard", shard.cast("int"))
    begin = F.when(F.col("shard") < more, F.col("shard") * (each + 1)).otherwise(first + (F.col("shard") - more) * each)
    return out.withColumn("slot", (F.col("rank") - begin).cast("long")).drop("rank", "total")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, lang, source, hilbert, shard and slot of every document, the texts left where they are.

    The dimensions are lang, source, size and doc_id. Null texts have crc 0 and no bytes; nulls in lang and source share
    a cell with rare values, in the others they are cell 0. Equal texts follow each other where their dimensions agree.
    Repeated rows are rows of their own. Texts of any length are read once and never moved. An empty table gives no
    rows. Other columns are not looked at. The result is written; the tables made on the way are deleted.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_sharded(docs, shards), "shards")


def _sharded(docs: DataFrame, shards: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "lang", "source")
    shares = F.array(*[F.lit(k / (1 << BITS)) for k in range(1, 1 << BITS)])
    low, high, cuts = rows.agg(F.min("doc_id").cast("double"), F.max("doc_id").cast("double"), F.percentile_approx("size", shares, 1000)).first()
    place = range_cell(F.col("doc_id"), F.lit(low).cast("double"), F.lit(high).cast("double"))
    cells = [category_cell(docs, "lang"), category_cell(docs, "source"), depth_cell(F.col("size"), cuts or []), place]
    return curve_shards(rows, cells, ["size", "text_crc32", "doc_id"], shards)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`: 24 runs of the curve with counts at most one apart."""
    out = shard_documents(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
