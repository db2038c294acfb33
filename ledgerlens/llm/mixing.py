"""Mixing overlapping sources to target weights, by a min-cost flow.

Documents are summed by the set of sources that they belong to (their pattern). A flow carries words from patterns to
the sources in them, up to each source's quota; the first time that a pattern's words are used costs nothing, every
further time more. Then documents are chosen in a seeded order until each pattern has given what the flow takes from it.
"""

from __future__ import annotations

import json
from collections import defaultdict, deque
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD, documents, materialize, scratch

#: Times that a document may be used; the seed of the order; bits of the order looked at in one round; documents on
#: either side of a pattern's cut among which its last words are looked for.
COPIES, SEED, BITS, LAST = 3, 20_240, 12, 256
#: Most rows of a plan that are broadcast.
FEW = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def member(source: Column) -> Column:
    """A source's name as members have it; a null source is one of its own."""
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source))


def weighted_targets(sizes: dict[str | None, int], most: int = COPIES) -> dict[str | None, float]:
    """Targets by weights 1, 2, 3, repeating, over the sources by code point (null last), that share all sizes.

    No target is above `most` times its source's size; what that leaves is shared again by weight.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: 1 + k % 3 for k, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = float(sum(sizes.values())), set(order)
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = [s for s in order if s in open_ and unit * weights[s] > most * sizes[s]]
        if not full:
            out |= {s: unit * weights[s] for s in open_}
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
            open_.remove(s)
    return out


def min_cost_flow(patterns: dict[str, int], members: dict[str, list[str]], quotas: dict[str, int], copies: int = COPIES) -> dict[str, dict[str, int]]:
    """Words that each pattern gives to each source, as many as quotas and copies allow, at the least cost.

    Every further use of a pattern's words costs more than the one before, and nothing else costs anything. So cheapest
    paths are those through the lowest use that has words left, and raising the capacities use by use, with all paths
    found at each, gives a flow of the least cost.
    """
    flow: dict[str, dict[str, int]] = {p: defaultdict(int) for p in patterns}
    holders: dict[str, list[str]] = defaultdict(list)
    for p in sorted(patterns):
        for s in members[p]:
            holders[s].append(p)
    need, free = dict(quotas), dict.fromkeys(patterns, 0)
    for _ in range(copies):
        for p, size in patterns.items():
            free[p] += size
        for p in sorted(patterns):  # words that can go to one source only go there first, which takes nothing from others
            if len(members[p]) == 1 and members[p][0] in need:
                amount = min(need[members[p][0]], free[p])
                flow[p][members[p][0]] += amount
                need[members[p][0]] -= amount
                free[p] -= amount
        while True:
            back: dict[str, tuple[str, str]] = {}  # a source is reached from a pattern, which was reached through a source or has words left
            came: dict[str, str | None] = {p: None for p in sorted(patterns) if free[p] > 0}
            queue, end = deque(came), None
            while queue and end is None:
                p = queue.popleft()
                for s in members[p]:
                    if s in back or s not in need:
                        continue
                    back[s] = (p, s)
                    if need[s] > 0:
                        end = s
                        break
                    for other in holders[s]:
                        if other not in came and flow[other][s] > 0:
                            came[other] = s
                            queue.append(other)
            if end is None:
                break
            path, s = [], end
            while s is not None:
                p = back[s][0]
                path.append((p, s))
                s = came[p]
            amount = min(need[end], free[path[-1][0]])
            for (p, _), (_, through) in zip(path, path[1:], strict=False):
                amount = min(amount, flow[p][through])
            for k, (p, s) in enumerate(path):
                flow[p][s] += amount
                if k + 1 < len(path):
                    flow[p][path[k + 1][1]] -= amount
            need[end] -= amount
            free[path[-1][0]] -= amount
    return {p: {s: n for s, n in f.items() if n} for p, f in flow.items()}


def _small(table: DataFrame, rows: int) -> DataFrame:
    """A table of numbers that the driver has made, to be broadcast if it has few rows, and joined as any other if not."""
    return F.broadcast(table) if rows <= FEW else table


def _cuts(rows: DataFrame, wanted: dict[str, int]) -> tuple[dict[str, tuple[int, int]], list[tuple[int]]] | None:
    """For each pattern the order's place before which all documents are taken, and single documents past it.

    Sums by the leading bits of the place find the bits at which a pattern has what is wanted; the next bits are looked
    at only among documents that have those. Each round's sums are at most 2**BITS rows a pattern. None: too many
    documents are at one place.
    """
    spark = rows.sparkSession
    state = {p: {"low": 0, "before": 0, "want": n} for p, n in wanted.items() if n > 0}
    open_, done = set(state), {}
    for level in range(1, 60 // BITS + 1):
        if not open_:
            break
        width = 60 - BITS * level
        at = spark.createDataFrame([(p, state[p]["low"], state[p]["low"] + (1 << (width + BITS)), state[p]["before"], state[p]["want"]) for p in sorted(open_)], "pattern string, low long, high long, before long, want long")
        here = rows.join(_small(at, len(open_)), "pattern").filter("place >= low and place < high")
        sums = here.groupBy("pattern", "before", "want", F.shiftright("place", width).alias("part")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        sums = sums.withColumn("end", F.expr("before + sum(size) over (partition by pattern order by part)"))
        sums = sums.withColumn("past", F.expr("sum(if(end > want, n, 0)) over (partition by pattern order by part)"))
        sums = sums.withColumn("ahead", F.expr("sum(if(end > want, 0, n)) over (partition by pattern order by part desc)"))
        over, at_part = F.col("end") > F.col("want"), F.struct("part", "end", "size", "n")
        found = sums.groupBy("pattern").agg(
            F.min(F.when(over, at_part)).alias("first"),
            F.max(F.when(over & (F.col("past") <= LAST), F.col("part"))).alias("last"),
            F.min(F.when(~over & (F.col("ahead") <= LAST), at_part)).alias("back"),
        ).filter("first is not null")
        seen = {r["pattern"]: r for r in found.collect()}
        for p in sorted(open_):
            r = seen.get(p)
            if r is None:  # the rest of the pattern is below what is wanted
                done[p] = (1 << 60, 1 << 60)
                open_.remove(p)
                continue
            state[p]["low"], state[p]["before"] = r["first"]["part"] << width, r["first"]["end"] - r["first"]["size"]
            if not width and r["first"]["n"] > 3 * LAST:
                return None
            if r["first"]["n"] <= LAST or not width:
                begin = r["back"] or r["first"]
                state[p]["before"] = begin["end"] - begin["size"]
                done[p] = (begin["part"] << width, (max(r["last"] or 0, r["first"]["part"]) + 1) << width)
                open_.remove(p)
    near = spark.createDataFrame([(p, *x) for p, x in done.items()], "pattern string, low long, high long")
    late = rows.join(_small(near, len(done)), "pattern").filter("place >= low and place < high and size > 0").select("pattern", "place", "size").collect()
    single = []
    for p, group in groupby(sorted(late, key=lambda r: (r["pattern"], r["place"])), key=lambda r: r["pattern"]):
        units = [(place, sum(r["size"] for r in rows)) for place, rows in groupby(group, key=lambda r: r["place"])]
        single += [(p, place) for place in fill(units, state[p]["want"] - state[p]["before"])]
    return done, single


def fill(units: list[tuple[int, int]], gap: int) -> list[int]:
    """Units (place, size) whose sizes come as near to the gap as they can without passing it, the first where there is a choice.

    Units are taken in order while they are many more than LAST; of the others every sum that can be reached is looked at.
    """
    out = []
    while len(units) > 3 * LAST:
        place, size = units.pop(0)
        if size <= gap:
            gap -= size
            out.append(place)
    sums, mask = [1], (1 << (gap + 1)) - 1  # bit n: the sum n can be reached
    for _, size in units:
        sums.append((sums[-1] | sums[-1] << size) & mask)
    left = sums[-1].bit_length() - 1
    for (place, size), before in zip(units[::-1], sums[-2::-1], strict=True):
        if not before >> left & 1:
            left -= size
            out.append(place)
    return out


@dataclass
class Plan:
    """What a mix takes: for each pattern whole uses of all its documents, and one more of those before the cut; and single places."""

    rows: list[tuple[str, int, int]]
    single: list[tuple[str, int]]
    seed: int
    by_row: bool = False

    def uses(self, rows: DataFrame) -> DataFrame:
        """rows (with uid, doc_id and members) with uses; both tables of the plan are some numbers for each pattern."""
        spark = rows.sparkSession
        out = placed(rows, self.seed, self.by_row)
        plan = spark.createDataFrame(self.rows, "_pattern string, _whole int, _cut long")
        single = spark.createDataFrame([(*x, 1) for x in self.single], "_pattern string, _place long, _extra int")
        out = out.join(_small(plan, len(self.rows)), "_pattern", "left").join(_small(single, len(self.single)), ["_pattern", "_place"], "left")
        more = F.when((F.col("_place") < F.col("_cut")) | F.col("_extra").isNotNull(), F.lit(1)).otherwise(F.lit(0))
        return out.withColumn("uses", F.coalesce("_whole", F.lit(0)) + more).drop("_whole", "_cut", "_extra", "_pattern", "_place")


def placed(rows: DataFrame, seed: int, by_row: bool) -> DataFrame:
    key = F.col("uid") if by_row else F.coalesce(F.col("doc_id").cast("long"), F.col("uid"))
    rows = rows.withColumn("_pattern", F.to_json(F.array_sort(F.array_distinct("members"))))
    return rows.withColumn("_place", F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 4))


def plan_mix(rows: DataFrame, quotas: dict[str, int], copies: int = COPIES, seed: int = SEED) -> Plan:
    """The plan of a mix. rows: uid (a number for each row), doc_id, members (an array of sources' names), size.

    Sources without a quota take nothing. The order is by hashed doc_id; rows with a null one go by uid, and so do all
    rows if one doc_id has very many. What comes to the driver is a row for each pattern and some for each pattern's
    cut, however many documents there are.
    """
    for by_row in (False, True):
        order = materialize(placed(rows, seed, by_row).select(F.col("_pattern").alias("pattern"), F.col("_place").alias("place"), "size"), "mix")
        patterns = {r["pattern"]: r["size"] for r in order.groupBy("pattern").agg(F.sum("size").alias("size")).collect()}
        members = {p: json.loads(p) for p in patterns}
        flow = min_cost_flow({p: n for p, n in patterns.items() if n}, members, quotas, copies)
        given = {p: sum(f.values()) for p, f in flow.items()}
        found = _cuts(order, {p: n % patterns[p] for p, n in given.items()})
        if found is not None:
            break
    cut, single = found
    return Plan([(p, given[p] // patterns[p] if p in given else 0, cut[p][0] if p in cut else 0) for p in sorted(patterns)], single, seed, by_row)


def mix(rows: DataFrame, quotas: dict[str, int], copies: int = COPIES, seed: int = SEED) -> DataFrame:
    """rows (see plan_mix) with uses, how often the mix takes each document (0 to copies)."""
    return plan_mix(rows, quotas, copies, seed).uses(rows)


def plan_documents(rows: DataFrame, seed: int = SEED) -> tuple[Plan, DataFrame]:
    """The plan that gives sources weights 1, 2, 3 in turn, and s, source_size and target of each source."""
    sizes = {r["source"]: r["size"] for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    targets = weighted_targets(sizes)
    quotas = {"null" if s is None else f"={s}": round(t) for s, t in targets.items()}
    info = rows.sparkSession.createDataFrame([(s, sizes[s], targets[s]) for s in sizes], "s string, source_size long, target double")
    return plan_mix(rows, quotas, seed=seed), info


def identified(docs: DataFrame) -> DataFrame:
    """docs with uid and members; uid depends on how the input's files are split, and matters for null ids only."""
    return docs.withColumn("uid", F.monotonically_increasing_id()).withColumn("members", F.array(member(F.col("source"))))


def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, uses and taken of every document.

    Sources are weighed 1, 2, 3 in turn and share all words. A null text has no words, a null source is a source. Rows
    with one id are taken together. A source with a third of all rows is summed by parts of the order. Other columns are
    not looked at. An empty table gives no rows. The driver holds a few numbers for each source.
    """
    with scratch(docs.sparkSession) as keep:
        rows = materialize(identified(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))), "sizes")
        plan, info = plan_documents(rows, seed)
        out = plan.uses(rows).join(_small(info, len(plan.rows)), F.col("source").eqNullSafe(F.col("s")))
        return keep(out.select("doc_id", "source", "size", "source_size", "target", "uses", (F.col("size") * F.col("uses")).alias("taken")), "mixed")


def realised(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it, so zero to COPIES times. Texts are not moved."""
    columns = docs.columns
    with scratch(docs.sparkSession):
        small = materialize(identified(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))), "sizes")
        plan, _ = plan_documents(small, seed)
    whole = identified(docs.select(F.struct(*columns).alias("_row"), "doc_id", "source"))
    out = plan.uses(whole).filter("uses > 0")
    return out.select(F.col("_row"), F.explode(F.sequence(F.lit(1), F.col("uses")))).select("_row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
