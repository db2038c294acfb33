"""Documents joined by the Jaccard similarity of their shingle sets, with signature trees.

1. Equal sets are one class. A class has a size and a signature.
2. In any fixed order of shingles, linked sets share one of the first n - ceil(0.8 n) + 1 (their prefix). The order is
   by hash, with frequent shingles put last, so that passages which many documents have don't bring their documents
   together. Frequent are those in many prefixes by hash alone, and those in several whole sets of a sample of classes:
   once some of a prefix are put last, others move up that no prefix by hash alone has. They are a bitmap of fixed size
   over hashes; a missed or false one only changes the order.
3. Classes that share a prefix shingle with few others make pairs; pairs whose sizes or signatures don't allow a link
   go. Classes that share one with many make a star; the components of the stars are crowds, and a signature tree over
   a crowd finds what signatures allow. A large crowd is no group to compare: chance joins ever more stars as the input
   grows. It falls apart into circles, the classes with one leader, so that only those with a shingle in common meet.
   The components of all that (clusters) hold every link.
4. A signature tree over each cluster, now with texts, finds links that are exact on the whole sets and connect all
   that is connected. A large circle or cluster is cut into blocks, each with its anchors; what is then outside the
   largest group is compared with every block, so no pair goes untested but those in one group.
5. The components of the links are the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrow, signature_tree
from .components import components
from .shared import SLOT_BITS, documents, freed_shuffles, marked, materialize, scratch, slot_of, slot_words
from .shingles import mix, shingle_sets

#: Most classes with one prefix shingle that are paired; those with more make a star.
FEW = 16
#: Classes of a cluster that one tree holds; and classes compared with a block at once.
BLOCK, ASKING = 128, 512
#: Classes of a crowd (those that share frequent prefix shingles) whose signatures one tree holds.
CROWD = 512
#: One class in so many gives its whole set to find frequent shingles; those that OFTEN of these have are frequent.
SAMPLE, OFTEN = 16, 4


#: Prefix rows that a task holds.
HELD = 1 << 20


def prefix_length(n):
    return n - (80 * n + 99) // 100 + 1


def class_of(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A number for each set, the same for equal sets (its size and the sum of its hashes, hashed)."""
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(shingles), dtype=np.uint64)])
    ends = np.cumsum(counts)
    return mix(sums[ends] - sums[ends - counts] + counts.astype(np.uint64)).view(np.int64)


def _prefixes(shingles: np.ndarray, counts: np.ndarray, late: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The prefix shingles of all sets, and how many each set has; `late` is the bitmap of those that come last."""
    owner = np.repeat(np.arange(len(counts)), counts)
    if late is not None:
        slot = (shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        last = (late[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)
        if last.any():
            order = np.lexsort((shingles, last, owner))
            shingles = shingles[order]
    length = np.where(counts > 0, prefix_length(counts), 0)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    return shingles[np.arange(len(shingles)) - first < length[owner]], length


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, mark (the text's hash), n, cls (null for an empty set), signature and prefix (by hash alone) of every document,
    and sample: the whole set of one class in SAMPLE, null elsewhere and where the task has given the class before.
    """
    rate = SAMPLE

    def run(batches):
        seen: set[int] = set()
        for part, texts in arrow.slices(batches):
            shingles, counts = shingle_sets(texts)
            cls = class_of(shingles, counts)
            prefix, length = _prefixes(shingles, counts, None)
            sampled = (counts > 0) & (mix(cls.view(np.uint64)) % np.uint64(rate) == 0)
            for k in np.flatnonzero(sampled).tolist():
                sampled[k] = (c := int(cls[k])) not in seen
                seen.add(c)
            places = pa.array(np.r_[0, np.cumsum(np.where(sampled, counts, 0))].astype(np.int32), mask=np.r_[~sampled, False])
            sample = pa.ListArray.from_arrays(places, pa.array(shingles[np.repeat(sampled, counts)].view(np.int64)))
            ends = np.cumsum(counts)
            marks = [signature_tree.bitmap(shingles[e - n : e], signature_tree.bits_for(n)).tobytes() if n else None for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            offsets = pa.array(np.r_[0, np.cumsum(length)].astype(np.int32))
            columns = [part.column("doc_id"), part.column("mark"), pa.array(counts.astype(np.int64)), pa.array(cls, mask=counts == 0), pa.array(marks, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(prefix.view(np.int64))), sample]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "n", "cls", "signature", "prefix", "sample"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow.map_texts(docs.select("doc_id", "text", F.xxhash64("text").alias("mark")), run, f"doc_id {kind}, mark long, n long, cls long, signature binary, prefix array<long>, sample array<long>")


def frequent(rows: DataFrame) -> np.ndarray:
    """The bitmap of shingles that more than FEW prefixes or at least OFTEN sampled classes have, as 64-bit words: 1 MB at
    any size of the input. rows: of sized.
    """

    def found(sets, least):
        counted = sets.select(F.explode("set").alias("s")).groupBy("s").count().filter(F.col("count") >= least)
        return counted.select(F.shiftrightunsigned("s", 64 - SLOT_BITS).alias("s"))

    sampled = rows.filter(F.col("sample").isNotNull()).groupBy("cls").agg(F.first("sample").alias("set"))
    words = slot_words(found(rows.select(F.col("prefix").alias("set")), FEW + 1).union(found(sampled, OFTEN))).collect()
    out = np.zeros(1 << (SLOT_BITS - 6), dtype=np.int64)
    for r in words:
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def prefix_rows(docs: DataFrame, late: np.ndarray) -> DataFrame:
    """place, shingle, cls, n, many: the prefix of each class, given once by each task that has the class.

    Of a shingle that more than FEW classes of a task have, the task gives the first class with their number as many,
    and for each of the others a row without a shingle that leads to the first (in many): it needn't meet the rest. So
    no shingle has more rows than a few for each task, whatever share of all classes has it. place: where rows that
    belong together meet; a task holds the rows of what it reads.
    """
    shared = docs.sparkSession.sparkContext.broadcast(late)

    def run(batches):
        seen: set[int] = set()
        held: list[list[np.ndarray]] = []

        def out():
            s, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((c, s))
            s, c, n = s[order], c[order], n[order]
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            many = np.diff(np.append(first, len(s)))
            nth = np.arange(len(s)) - np.repeat(first, many)
            hot = np.repeat(many > FEW, many)
            leader = np.repeat(c[first], many)
            told = np.flatnonzero(hot & (nth > 0))
            kept = ~hot | (nth == 0)
            rows = [(s[kept], s[kept], c[kept], n[kept], np.where(hot[kept], np.repeat(many, many)[kept], 1)), (mix(c[told].view(np.uint64)).view(np.int64), None, c[told], n[told], leader[told])]
            for place, shingle, cls, size, number in rows:
                for k in range(0, len(cls), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    shingles = pa.array(shingle[part]) if shingle is not None else pa.nulls(len(cls[part]), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(place[part]), shingles, pa.array(cls[part]), pa.array(size[part].astype(np.int32)), pa.array(number[part].astype(np.int64))], ["place", "shingle", "cls", "n", "many"])

        for _, texts in arrow.slices(batches):
            shingles, counts = shingle_sets(texts)
            cls = class_of(shingles, counts)
            prefix, length = _prefixes(shingles, counts, shared.value)
            new = np.zeros(len(texts), dtype=bool)
            for k, c in enumerate(cls.tolist()):
                if counts[k] and c not in seen:
                    seen.add(c)
                    new[k] = True
            owner = np.repeat(np.arange(len(texts)), length)
            keep = new[owner]
            owner = owner[keep]
            if len(owner):
                held.append([prefix[keep].view(np.int64), cls[owner], counts[owner]])
                if sum(len(x[0]) for x in held) > HELD:
                    yield from out()
        if held:
            yield from out()

    return arrow.map_texts(docs.select("text"), run, "place long, shingle long, cls long, n int, many long")


#: Kinds of rows that met() gives.
PAIR, STAR, TOLD = 0, 1, 2


def met(rows: DataFrame) -> DataFrame:
    """kind, a, b, n: pairs of classes with a rare shingle in common whose sizes allow a link (a < b), and, for each class
    that has a frequent one with others, the class (a, of size n) and one that leads (b), as often as it has such: TOLD
    if b led in a task, and is itself led by one that leads all, else STAR.

    rows of prefix_rows. They move once; those with one shingle are sorted by class and looked at as they come: of a
    frequent one the first class leads and no other is held, of a rare one there are FEW at most.
    """

    def run(batches):
        held: list[np.ndarray] | None = None  # rows of the last shingle that may be a rare one
        leading: tuple[int, int] | None = None  # the last shingle that is frequent, and who leads

        def made(kind, a, b, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(a), pa.array(b), pa.array(n.astype(np.int32))], ["kind", "a", "b", "n"])

        def look(s, c, n, w):
            """Rows of whole shingles, or of frequent ones of which more may come."""
            nonlocal leading
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            size = np.diff(np.append(first, len(s)))
            heavy = np.add.reduceat(w, first) > FEW
            leader = c[first].copy()
            if leading is not None and s[0] == leading[0]:
                heavy[0], leader[0] = True, leading[1]
            # a class alone leads nobody, unless it has led in its task, or more rows were or are to come
            told = (c[first + size - 1] != leader) | (np.maximum.reduceat(w, first) > FEW)
            told[0] |= leading is not None and s[0] == leading[0]
            told[-1] = True
            star = np.repeat(heavy & told, size)
            if star.any():
                yield made(STAR, c[star], np.repeat(leader, size)[star], n[star])
            if heavy[-1]:
                leading = (s[-1], leader[-1])
            light = ~np.repeat(heavy, size)
            s, c, n = s[light], c[light], n[light].astype(np.int64)
            found = []
            for shift in range(1, FEW):
                i = np.flatnonzero(s[shift:] == s[:-shift])
                if not len(i):
                    break
                j = i + shift
                good = (100 * np.minimum(n[i], n[j]) >= 80 * np.maximum(n[i], n[j])) & (c[i] != c[j])
                found.append(np.stack([np.minimum(c[i], c[j])[good], np.maximum(c[i], c[j])[good]]))
            if found:
                pairs = np.unique(np.concatenate(found, axis=1), axis=1)
                yield made(PAIR, pairs[0], pairs[1], np.zeros(pairs.shape[1]))

        for batch in with_end(batches):
            parts = [held] if held is not None else []
            if batch is not None:
                told = batch.filter(batch.column("shingle").is_null())
                if len(told):
                    yield made(TOLD, *(told.column(x).to_numpy() for x in ("cls", "many", "n")))
                plain = batch.filter(batch.column("shingle").is_valid())
                parts.append([plain.column(x).to_numpy(zero_copy_only=False) for x in ("shingle", "cls", "n", "many")])
            if not parts:
                continue
            s, c, n, w = (np.concatenate(x) for x in zip(*parts, strict=True))
            held = None
            if not len(s):
                continue
            stop = len(s)
            if batch is not None:  # the last shingle may go on
                last = int(np.searchsorted(s, s[-1]))
                if w[last:].sum() <= FEW and not (leading is not None and s[-1] == leading[0]):
                    held, stop = [x[last:] for x in (s, c, n, w)], last
            if stop:
                yield from look(s[:stop], c[:stop], n[:stop], w[:stop])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "place").sortWithinPartitions("shingle", "cls").drop("place")
    return dealt.mapInArrow(run, "kind int, a long, b long, n int")


def with_end(batches):
    yield from batches
    yield None


def allowed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose signatures allow a link. classes: cls, n, signature."""

    def run(batches):
        for batch in batches:
            read = lambda c: [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(c)]
            keep = [signature_tree.may_link(*x) for x in zip(read("sa"), batch.column("na").to_pylist(), read("sb"), batch.column("nb").to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    of = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "na", "sa", "b", "nb", "sb").mapInArrow(run, "a long, b long")


def tree_links(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Links a, b between classes of rows with equal keys, by a signature tree over each such group.

    rows: keys, cls, known (a group's number), asks, and either text, then links are exact, or n and signature, then
    they are what signatures allow.
    """
    exact = "text" in rows.columns

    def run(batches):
        for table in arrow.runs(batches, keys):
            cls, known, asks = (table.column(c).to_pylist() for c in ("cls", "known", "asks"))
            test = None
            if exact:
                shingles, size = shingle_sets(table.column("text").to_pylist())
                ends, true = np.cumsum(size), class_of(shingles, size).tolist()
                # a class once; and a repeated doc_id brings texts of other classes
                at = sorted({c: k for k, c in reversed([*enumerate(cls)]) if true[k] == c}.values())
                sets = [shingles[ends[k] - size[k] : ends[k]] for k in at]
                size = size[at]
                marks = [signature_tree.bitmap(x, signature_tree.bits_for(len(x))) for x in sets]
                test = lambda i, j, sets=sets: signature_tree.linked(sets[i], sets[j])
            else:
                at = sorted({c: k for k, c in reversed([*enumerate(cls)])}.values())
                marks = [np.frombuffer(table.column("signature")[k].as_buffer(), dtype=np.uint64) for k in at]
                size = table.column("n").to_numpy()[at]
            found = signature_tree.links(marks, size, test, [known[k] for k in at], [asks[k] for k in at])
            a, b = ([cls[at[p[side]]] for p in found] for side in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return arrow.map_texts(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys, F.desc("asks"), "cls"), run, "a long, b long")


def with_texts(members: DataFrame, docs: DataFrame) -> DataFrame:
    """members (cls, doc and mark: id and hash of the text of a document with that class) with that document's text.

    A bitmap of fixed size over hashed texts, broadcast, keeps most texts of other documents from being moved.
    """
    near = docs.select("doc_id", "text", F.xxhash64("text").alias("_mark"))
    near = marked(near, "_mark", slot_words(members.select(slot_of("mark")))).filter("marked").drop("marked")
    return near.join(members, near.doc_id.eqNullSafe(members.doc) & (near["_mark"] == members.mark)).drop("doc_id", "_mark", "mark")


def cluster_links(members: DataFrame, block: int) -> DataFrame:
    """Links that connect all that is connected within clusters.

    members: component, cls, n, weight (for the choice of anchors), and text or signature. A cluster is dealt into
    blocks, each with the anchors; a tree over each block finds its links. What is then outside the largest group of its
    cluster is compared, some at a time, with every block.
    """
    payload = "text" if "text" in members.columns else "signature"
    stats = members.groupBy("component").agg(
        F.count("*").alias("size"),
        F.array(F.max_by("cls", F.struct("weight", "cls")), F.min_by("cls", F.struct("n", "cls")), F.min("cls")).alias("anchors"),
    )
    rows = members.join(materialize(stats, "stats"), "component").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))  # written, so that Spark can split the join
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("anchor", F.array_contains("anchors", F.col("cls")))
    spread = F.when(F.col("anchor"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    first = rows.select("component", F.explode(spread).alias("block"), "cls", "n", payload, F.col("cls").alias("known"), F.lit(True).alias("asks"))
    found = materialize(tree_links(first, ["component", "block"]), "links")
    large = rows.filter("blocks > 1").select("component", "cls", "n", payload, "blocks", "own")
    if large.isEmpty():
        return found
    groups = components(found)
    known = F.coalesce("known", "cls")
    grouped = large.select("component", "cls").join(groups.select(F.col("node").alias("cls"), F.col("component").alias("known")), "cls", "left").withColumn("known", known)
    grouped = materialize(grouped, "grouped")
    counted = grouped.groupBy("component", "known").count()
    main = counted.groupBy("component").agg(F.max_by("known", F.struct("count", "known")).alias("main"), F.expr("sum(count) - max(count)").alias("outside"))
    large = large.join(grouped, ["component", "cls"]).join(materialize(main.filter("outside > 0"), "main"), "component")
    parts = F.ceil(F.col("outside") / ASKING).cast("int")
    each = large.select("component", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("own").alias("block"), "cls", "n", payload, "known", F.lit(False).alias("asks"))
    asking = large.filter("known <> main").select("component", F.pmod(F.xxhash64("cls", F.lit(1)), parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "cls", "n", payload, "known", F.lit(True).alias("asks"))
    return found.union(tree_links(each.union(asking), ["component", "part", "block"]))


def circles(stars: DataFrame, crowds: DataFrame, marks: DataFrame) -> DataFrame:
    """component, cls, n, signature, weight: groups that hold all pairs of classes with a frequent shingle in common.

    stars: kind, a, b, distinct; crowds: component and cls, their components; marks: of each class. A crowd that a tree
    holds is a group. Of a larger one, each leader's classes are, with those that one of them leads in a task. A leader
    with more than CROWD has a group for each two neighbouring ranges of sizes: linked sizes are in one or in two.
    """
    sizes = materialize(crowds.groupBy("component").agg(F.count("*").alias("size")), "crowds")
    large = materialize(crowds.join(sizes.filter(F.col("size") > CROWD), "component").select("cls"), "large-crowds")
    if large.isEmpty():
        return crowds.join(marks, "cls")
    whole = crowds.join(sizes.filter(F.col("size") <= CROWD), "component").select("component", "cls").join(marks, "cls")
    of = stars.join(large, stars.a == large.cls).select("kind", "cls", F.col("b").alias("leader"))
    led = of.filter(F.col("kind") == STAR).select("cls", "leader")
    told = of.filter(F.col("kind") == TOLD).select("cls", F.col("leader").alias("first")).join(led.withColumnRenamed("cls", "first"), "first")
    led = materialize(led.union(told.select("cls", "leader")).distinct(), "led")
    counted = materialize(led.groupBy("leader").agg(F.count("*").alias("size")).filter("size > 1"), "leaders")  # written, so that Spark can split the join
    own = F.floor(F.log("n") / math.log(1.25)).cast("int")
    rows = led.join(counted, "leader").join(marks, "cls")
    rows = rows.withColumn("range", F.explode(F.when(F.col("size") > CROWD, F.array(own, own + 1)).otherwise(F.array(F.lit(-1)))))
    return whole.unionByName(rows.withColumn("component", F.xxhash64("leader", "range")).drop("leader", "size", "range"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to) of every document.

    Texts are whole; null, empty and wordless ones have no shingles and link with nothing, so their component is their
    own id. Repeated rows are rows of their own, linked by their equal sets. A null doc_id is no component's smallest
    unless all are null. Other columns of docs are not looked at. An empty table gives no rows. The result is written;
    the tables made on the way are deleted.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep, freed_shuffles(spark):
        return keep(_components(docs), "jaccard-components")


def _components(docs: DataFrame) -> DataFrame:
    with scratch(docs.sparkSession) as keep:  # prefixes and samples go before prefix rows move
        rows = materialize(sized(docs), "sized")
        late = frequent(rows)
        # copies meet here once, after each task has summed its own; later joins have a row for each class
        one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark"))
        classes = rows.filter("n > 0").groupBy("cls").agg(one.alias("one"), F.max("n").alias("n"), F.first("signature").alias("signature"))
        classes = keep(classes.select("cls", F.col("one.doc_id").alias("doc"), "one.mark", "n", "signature"), "classes")
        rows = keep(rows.select("doc_id", "n", "cls"), "rows")
    found = materialize(met(prefix_rows(docs, late)), "met")
    few = materialize(found.filter(F.col("kind") == PAIR).select("a", "b").distinct(), "pairs")
    stars = found.filter(F.col("kind") != PAIR)
    weight = stars.groupBy(F.col("a").alias("cls")).agg((F.count("*") / F.max("n")).alias("weight"))
    wanted = few.select(F.explode(F.array("a", "b")).alias("cls")).union(weight.select("cls")).distinct()
    marks = materialize(classes.select("cls", "n", "signature").join(wanted, "cls", "left_semi").join(weight, "cls", "left").fillna(0.0, ["weight"]), "marks")
    stars = materialize(stars.select("kind", "a", "b").distinct(), "stars")
    crowds = components(stars.select("a", "b")).withColumnsRenamed({"node": "cls"})
    edges = allowed(few, marks).union(cluster_links(circles(stars, crowds, marks), CROWD))
    clusters = components(edges).withColumnsRenamed({"node": "cls"})
    members = clusters.join(classes.select("cls", "doc", "mark"), "cls").join(marks.select("cls", "n", "weight"), "cls")
    texts = materialize(with_texts(materialize(members, "members"), docs), "cluster-texts")
    groups = components(cluster_links(texts, BLOCK)).withColumnsRenamed({"node": "cls"})
    # what has no class stands alone
    named = rows.select("doc_id", "n", "cls").join(groups, "cls", "left").withColumn("key", F.coalesce("component", "cls"))
    least = materialize(named.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least")), "least")  # so that Spark can split the join
    out = named.join(least, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def without_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id, null after all, and of equal ids any one.

    Rows whose ids don't name them (null, repeated, not a long or too large for one) are written with a number of their
    own. Texts of the others are moved only where their ids share a place in a bitmap of fixed size with one that goes.
    """
    spark = docs.sparkSession
    first = 1 << 62
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text").withColumn("_id", F.expr("try_cast(doc_id as bigint)"))  # so that no name clashes
    with scratch(spark) as keep:
        names = whole.groupBy("_id").agg(F.count("*").alias("_rows"))
        shared = keep(names.filter(F.col("_id").isNull() | (F.col("_rows") > 1) | (F.col("_id") >= first)).select("_id"), "shared-ids")
        if shared.isEmpty():
            named, odd = whole, None
        else:
            odd = whole.join(shared, whole["_id"].eqNullSafe(shared["_id"]), "left_semi")
            odd = keep(odd.withColumn("_id", F.lit(first) + F.monotonically_increasing_id()), "odd-rows")
            named = whole.join(shared, whole["_id"].eqNullSafe(shared["_id"]), "left_anti").union(odd)
        found = jaccard_components(named.select(F.col("_id").alias("doc_id"), "text"))
        gone = found.select(F.col("doc_id").alias("_id"), F.col("component_id").alias("_stays"))
        if odd is not None:  # numbers don't stand in the order of ids
            real = gone.join(odd.select("_id", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("real"), "_id").alias("_real")), "_id", "left")
            groups = real.filter(F.col("_real").isNotNull()).select("_stays").distinct()
            own = F.coalesce("_real", F.struct(F.lit(False).alias("none"), F.col("_id").cast(docs.schema["doc_id"].dataType).alias("real"), "_id"))
            best = real.join(groups, "_stays", "left_semi").groupBy("_stays").agg(F.min(own).alias("_best")).select("_stays", F.col("_best._id").alias("_best"))
            gone = gone.join(best, "_stays", "left").select("_id", F.coalesce("_best", "_stays").alias("_stays"))
        gone = keep(gone.filter(F.col("_id") != F.col("_stays")).select("_id"), "copies")
        words = keep(slot_words(gone.select(slot_of("_id"))), "copies-bitmap")
    rows = marked(named, "_id", words)
    some = rows.filter("marked").join(gone, "_id", "left_anti")
    return rows.filter("not marked").select("_row.*").union(some.select("_row.*"))
