"""Nearest neighbours by shifted space-filling curves.

Each ordering projects the vectors onto a few random directions, shifts and quantises them, and sorts them along a
Hilbert curve. A query looks at a fixed number of places on either side of its own in every ordering; what it finds is
merged and ranked by true distances. That is all of the answer if it need not be whole. If it must be, the distance of
the last one found bounds what may be nearer: the table, in blocks along the first curve, is read once more, and a
query is compared with those blocks that come so near to it. Vectors in groups leave few such blocks; vectors without
any structure have no short way to their neighbours and leave nearly all, each compared once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .hilbert import hilbert_index
from .shared import materialize, new_path, ranked, scratch, table

#: Orderings, projected dimensions and bits of each; places that a query looks at on either side; directions that bound
#: a block, vectors in one; bytes of queries that the driver sends out at once; vectors that the projections' ranges are
#: taken from, in expectation.
ORDERINGS, DIMENSIONS, BITS, WINDOW, SHADOW, BLOCK, SENT, SAMPLE = 4, 6, 8, 32, 16, 512, 1 << 25, 10_000
SEED = 11


def usable(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite components, and not zero."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Curves:
    """For each ordering a matrix of directions, and what maps a projection to cells: (x - low) * scale + shift."""

    directions: np.ndarray
    low: np.ndarray
    scale: np.ndarray
    shift: np.ndarray

    def keys(self, vectors: np.ndarray, k: int) -> np.ndarray:
        cells = ((vectors @ self.directions[k] - self.low[k]) * self.scale[k] + self.shift[k]) * (1 << BITS)
        return hilbert_index(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS).astype(np.int64)


def fit(sample: np.ndarray, orderings: int = ORDERINGS, seed: int = SEED) -> Curves:
    """Random directions (orthogonal within an ordering) and shifts; ranges from the sample."""
    r, dim = np.random.default_rng(seed), sample.shape[1]
    m = min(DIMENSIONS, dim)
    directions = np.stack([np.linalg.qr(r.standard_normal((dim, dim)))[0][:, :m] for _ in range(orderings)])
    low, high = np.empty((orderings, m)), np.empty((orderings, m))
    for k in range(orderings):
        low[k], high[k] = np.quantile(sample @ directions[k], [0.001, 0.999], axis=0) if len(sample) else (np.zeros(m), np.ones(m))
    return Curves(directions, low, 0.75 / np.maximum(high - low, 1e-12), r.random((orderings, m)) * 0.25)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def in_windows(order: DataFrame, size: Column, window: int) -> DataFrame:
    """query and uid: the candidates at most `window` places from a query in some ordering. order: curve, at, uid, asks, candidate."""
    places = F.sequence(F.greatest(F.col("at") - window, F.lit(0)), F.least(F.col("at") + window, size - 1))
    asking = order.filter("asks").select("curve", F.col("uid").alias("query"), F.explode(places).alias("at"))
    return asking.join(order.filter("candidate").select("curve", "at", "uid"), ["curve", "at"]).filter("query <> uid").select("query", "uid").distinct()


@dataclass
class Asked:
    """Queries (uid, vectors) with the distances within which their k nearest lie, and the k nearest found so far."""

    uid: np.ndarray
    vectors: np.ndarray
    reach: np.ndarray
    directions: np.ndarray
    k: int

    def __post_init__(self):
        self.shadows, self.norms = self.vectors @ self.directions, (self.vectors**2).sum(1)
        self.owner = np.zeros(0, dtype=np.int64)
        self.found = np.zeros(0, dtype=[("vec_id", "i8"), ("uid", "i8"), ("score", "f8")])
        self.tested = 0

    def look(self, uid: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Compares a block of candidates with the queries that its bounds allow.

        The directions are orthonormal, so a query is as far from the block as its shadow is from the box of shadows.
        """
        shadows = x @ self.directions
        apart = np.maximum(np.maximum(shadows.min(0) - self.shadows, self.shadows - shadows.max(0)), 0)
        near = np.flatnonzero(~((apart**2).sum(1) > self.reach**2 * (1 + 1e-9)))
        self.tested += len(near) * len(x)
        if not len(near):
            return
        norms = (x**2).sum(1)
        with np.errstate(invalid="ignore", over="ignore"):  # what isn't a number is looked at
            squares = self.norms[near, None] + norms - 2 * (self.vectors[near] @ x.T)
            slack = 1e-9 * (self.norms[near, None] + norms.max())
            q, c = np.nonzero(~(squares > self.reach[near, None] ** 2 * (1 + 1e-9) + slack))
            q = near[q]
            other = self.uid[q] != uid[c]
            q, c = q[other], c[other]
            made = np.empty(len(q), dtype=self.found.dtype)
            made["vec_id"], made["uid"] = ids[c], uid[c]
            for k in range(0, len(q), 1 << 16):
                d = self.vectors[q[k : k + (1 << 16)]] - x[c[k : k + (1 << 16)]]
                made["score"][k : k + (1 << 16)] = np.sqrt(np.einsum("ij,ij->i", d, d))
        good = made["score"] <= self.reach[q] * (1 + 1e-9)
        owner, found = np.concatenate([self.owner, q[good]]), np.concatenate([self.found, made[good]])
        order = np.lexsort((found["uid"], found["vec_id"], found["score"], owner))
        owner, found = owner[order], found[order]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        nth = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
        last = np.flatnonzero(nth == self.k - 1)
        self.reach[owner[last]] = np.minimum(self.reach[owner[last]], found["score"][last])
        self.owner, self.found = owner[nth < self.k], found[nth < self.k]




def neighbours(vectors: DataFrame, asks: Column, k: int = 10, window: int = WINDOW, orderings: int = ORDERINGS, whole: bool = True) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest of each asking vector.

    vectors: vec_id, embedding (of floats or doubles). A candidate is every row but the query's own. With whole=False the
    answer is what the windows hold. Rows with a null id or without a usable vector take no part, nor do vectors of
    another length than most have. Ties go to the smaller vec_id. Of equal vectors only the k + 1 rows with the smallest
    ids are candidates: the others have k nearer ones, by the ties, for any query. Rows with one id are rows of their
    own. An empty table gives no rows. Other columns are not looked at. The result is written; the tables made on the way
    are deleted. Queries go out a bounded part at a time, each part against all blocks.
    """
    with scratch(vectors.sparkSession) as keep:
        return _neighbours(vectors, asks, k, window, orderings, whole, keep)


def _neighbours(vectors: DataFrame, asks: Column, k: int, window: int, orderings: int, whole: bool, keep) -> DataFrame:
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    number = kind[6:-1]
    rows = vectors.select("vec_id", F.col("embedding").cast(kind).alias("embedding"), asks.alias("asks")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0).cast(number)))  # -0.0 is 0.0
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long"), "embedding", F.coalesce("asks", F.lit(False)).alias("asks")), "vectors")
    dims = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("embedding") == dims["d"])
    place = F.shiftrightunsigned(F.xxhash64("uid"), 11) / float(1 << 53)
    sample = rows.filter(place < SAMPLE / dims["count"]).select("embedding").toPandas()["embedding"]
    curves = fit(np.array(sample.tolist(), dtype=np.float64).reshape(-1, dims["d"]), orderings)
    shared = spark.sparkContext.broadcast(curves)
    equal = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("vec_id", "uid")
    candidates = rows.withColumn("nth", F.row_number().over(equal)).filter(F.col("nth") <= k + 1)

    def first_key(batches):
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.keys(_matrix(batch.column("embedding")), 0))], [*batch.schema.names, "key"])

    def all_keys(batches):
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column("embedding"))
                for c in range(len(shared.value.directions)):
                    added = [pa.array(np.full(len(batch), c, dtype=np.int32)), pa.array(shared.value.keys(x, c))]
                    yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("uid", "asks", "candidate")), *added], ["uid", "asks", "candidate", "curve", "key"])

    columns = f"uid long, vec_id long, embedding {kind}, asks boolean"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    along = candidates.select("uid", "vec_id", "embedding", "asks").mapInArrow(first_key, f"{columns}, key long")
    along = materialize(along.repartitionByRange(n, "key", "vec_id", "uid").sortWithinPartitions("key", "vec_id", "uid"), "candidates")
    asking = rows.filter("asks")
    both = along.select("uid", "embedding", "asks", F.lit(True).alias("candidate")).union(
        asking.join(along.filter("asks").select("uid"), "uid", "left_anti").select("uid", "embedding", "asks", F.lit(False).alias("candidate"))
    )
    keyed = both.mapInArrow(all_keys, "uid long, asks boolean, candidate boolean, curve int, key long")
    order = ranked(keyed.withColumn("tie", F.xxhash64("curve", "uid")), ["curve", "key", "tie"], "curves")  # ties fall differently on each curve
    size = F.col("total") / orderings
    order = order.withColumn("at", (F.col("rank") - F.col("curve") * size).cast("long"))
    pairs = in_windows(order, size.cast("long"), window)
    asked = asking.select(F.col("uid").alias("query"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    near = pairs.join(along.select("uid", "vec_id", "embedding"), "uid").join(asked, "query")
    apart = F.aggregate(F.zip_with("embedding", "asked", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    near = near.select("query", "query_id", "uid", "vec_id", F.sqrt(apart).alias("score"))
    best = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id", "uid"))
    if not whole:
        return keep(near.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "neighbours")
    reach = near.groupBy("query").agg(F.get(F.array_sort(F.collect_list("score")), F.lit(k - 1)).alias("reach"))  # of the candidates in windows
    asked = asked.join(reach, "query", "left").join(order.filter("curve = 0").select(F.col("uid").alias("query"), "at"), "query")
    asked = ranked(asked, ["at"], "asked")
    step = max(1, SENT // (8 * (dims["d"] + 4 + 3 * k)))
    path, kinds = new_path(spark, "found"), "query long, query_id long, uid long, vec_id long, score double"
    spark.createDataFrame([], kinds).write.parquet(path)
    for begin in range(0, asked.count(), step):
        part = asked.filter(F.col("rank").between(begin, begin + step - 1)).select("query", "query_id", "asked", "reach").toPandas()
        vectors_of = np.array(part["asked"].tolist(), dtype=np.float64).reshape(len(part), -1)
        sent = spark.sparkContext.broadcast((part["query"].to_numpy(), part["query_id"].to_numpy(), vectors_of, part["reach"].astype(float).fillna(np.inf).to_numpy()))
        along.select("uid", "vec_id", "embedding").mapInArrow(_searched(sent, k), kinds).write.mode("append").parquet(path)
        sent.unpersist()
    found = spark.read.schema(kinds).parquet(path)
    return keep(found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "neighbours")


def _searched(sent, k: int):
    """What a task does with its part of the candidates: at most k rows for each query leave it."""

    def search(batches):
        uid, ids, x, reach = sent.value
        directions = np.linalg.qr(np.random.default_rng(SEED).standard_normal((x.shape[1], x.shape[1])))[0][:, :SHADOW]
        asked = Asked(uid, x, reach.copy(), directions, k)
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                asked.look(part.column("uid").to_numpy(), part.column("vec_id").to_numpy(), _matrix(part.column("embedding")))
        for at in range(0, len(asked.owner), 1 << 16):
            owner, found = asked.owner[at : at + (1 << 16)], asked.found[at : at + (1 << 16)]
            columns = [uid[owner], ids[owner], *(np.ascontiguousarray(found[c]) for c in ("uid", "vec_id", "score"))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "query_id", "uid", "vec_id", "score"])

    return search


def op6_curve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
