"""Places and steps that several operators use."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere in this package: space and the six ASCII control spaces.
NOT_SPACE = r"[^\x20\x09-\x0D]"
WORD = NOT_SPACE + "+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_paths: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    _paths.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _paths[-1]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and returns the written table.

    The result doesn't depend on executors or shuffle files that made it, and reading it twice gives the same rows.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def delete(spark: SparkSession, path: str) -> None:
    at, system = _at(spark, path)
    system.delete(at, True)


def move(spark: SparkSession, old: str, new: str) -> bool:
    """Gives a folder another name; False where there is none."""
    at, system = _at(spark, old)
    return bool(system.exists(at)) and bool(system.rename(at, _at(spark, new)[0]))


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables that are written inside, but for what the given function writes.

    with scratch(spark) as keep: result = keep(df, label) writes df at once, so that nothing inside is needed later.
    """
    begin, kept = len(_paths), set()

    def keep(df: DataFrame, label: str) -> DataFrame:
        out = materialize(df, label)
        kept.add(_paths[-1])
        return out

    try:
        yield keep
    finally:
        for path in [p for p in _paths[begin:] if p not in kept]:
            delete(spark, path)
            _paths.remove(path)


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Queries that run inside delete their shuffle files as they end, not when the driver happens to collect its garbage.

    For what is written with materialize: no query reads another's shuffle files. The setting is put back.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, by: list[str], label: str, partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """df with `rank`, its place from 0 in the order of `by`, and `total`, the number of rows, without a global window.

    Rows are dealt by range and sorted in each partition; the written table keeps partition and place, and the
    counts of the partitions (a row for each, so bounded by their number) give every partition's offset.
    Ties are broken by the place in which the input was read. With `weight`, `before` is the sum of that column
    over all rows in front.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    dealt = df.withColumn("_tie", at).repartitionByRange(n, *by, "_tie").sortWithinPartitions(*by, "_tie")
    dealt = dealt.withColumn("_at", at).drop("_tie")
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    kept = materialize(dealt, label)
    sums = [F.count("*").alias("_n")] + ([F.sum(weight).alias("_w")] if weight else [])
    parts = kept.groupBy("_part").agg(*sums)
    offsets = " , ".join(
        ["_part", "coalesce(sum(_n) over (order by _part rows between unbounded preceding and 1 preceding), 0) as _offset", "sum(_n) over () as total"]
        + (["coalesce(sum(_w) over (order by _part rows between unbounded preceding and 1 preceding), 0) as _before"] if weight else [])
    )
    out = kept.join(F.broadcast(parts.selectExpr(*offsets.split(" , "))), "_part").withColumn("rank", F.col("_offset") + F.col("_at"))
    if weight:
        run = f"coalesce(sum({weight}) over (partition by _part order by _at rows between unbounded preceding and 1 preceding), 0)"
        out = out.withColumn("before", F.expr(f"_before + {run}").cast("long")).drop("_before")
    return out.drop("_part", "_at", "_offset")


#: Bits of the number of places in a bitmap of fixed size.
SLOT_BITS = 23


def slot_of(column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << SLOT_BITS))


def slot_words(slots: DataFrame) -> DataFrame:
    """word and bits of a bitmap with the given places (one column) set: 2**17 rows of 16 bytes at most."""
    return slots.toDF("s").groupBy((F.col("s") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("bits"))


def marked(rows: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """rows with `marked`, whether the key's place is set in the bitmap, which is broadcast: its size is bounded."""
    out = rows.withColumn("_slot", slot_of(key)).withColumn("_word", (F.col("_slot") / 64).cast("int"))
    out = out.join(F.broadcast(words.toDF("_word", "_bits")), "_word", "left")
    return out.withColumn("marked", F.coalesce(F.expr("getbit(_bits, cast(_slot % 64 as int)) = 1"), F.lit(False))).drop("_slot", "_word", "_bits")
