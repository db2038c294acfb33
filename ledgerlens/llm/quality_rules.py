"""Quality by a learned decision list, in DataFrame functions only.

Statistics of a text are compared with thresholds; a rule is a conjunction of such comparisons, and a list of rules says
which texts go. Rules are learned one after another: each grows by the comparison that gains most on one part of the
labelled rows, is pruned on the other part, and covers rows that later rules don't see. The list is one Spark
conditional expression.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import NOT_SPACE, documents, let, materialize, scratch, table

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Labelled rows that are learned from, in expectation; thresholds tried for each statistic; rules and comparisons at most.
SAMPLE, STEPS, RULES, TERMS = 20_000, 24, 16, 4
#: Least share of bad rows, and least number of them, among those that a rule covers, on either part.
PRECISION, SUPPORT = 0.95, 4


def window_hashes(hashes: Column, n: Column) -> Column:
    """The hashes of all windows of five in n (five or more) numbers: of two, of two such pairs, and of those and one more."""
    meet = lambda a, b, shift, k: F.zip_with(F.slice(a, 1, k), F.slice(b, 1 + shift, k), lambda x, y: F.xxhash64(x, y))
    return let(meet(hashes, hashes, 1, n - 1), lambda twos: meet(meet(twos, twos, 2, n - 3), hashes, 4, n - 4))


def repeat_words(hashes: Column) -> Column:
    """How many words lie in windows of five that are found twice or more. hashes: of the words, 64 bits each.

    A repeated window that begins at a place covers as many words more as lie between it and the next that is repeated,
    five at most.
    """

    def covered(windows: Column) -> Column:
        marked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(pairs: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(pairs, a)["h"] == F.get(pairs, b)["h"], F.lit(False))
            kept = F.filter(pairs, lambda x, k: same(k, k - 1) | same(k, k + 1))
            return F.array_sort(F.transform(kept, lambda x: x["i"]))

        def total(at: Column) -> Column:
            return F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda s, x: s + x)

        return let(marked, lambda pairs: let(places(pairs), total))

    found = let(window_hashes(hashes, F.size(hashes)), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(hashes) > WINDOW, found).otherwise(F.lit(0).cast("long"))


#: What is counted by single characters, as insides of character classes.
KINDS = {"n_symbols": re.escape(SYMBOLS), "digits": "0-9", "calls": "!?", "stops": ".,;:", "capitals": r"\p{Lu}"}


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The `keep` columns of docs with the counts and ratios of each text; a null text is an empty one.

    A text is split into words once and into lines once, words are hashed once, and one pass leaves the few characters
    that are counted one by one.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    of_words = lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.struct(F.size(h).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeat_words(h).alias("repeated"), F.size(F.array_distinct(h)).alias("distinct")))
    per_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again")))
    counted = let(F.regexp_replace(text, f"[^{''.join(KINDS.values())}]+", ""), lambda c: F.struct(*[F.length(F.regexp_replace(c, f"[^{inside}]+", "")).cast("long").alias(name) for name, inside in KINDS.items()]))
    rows = docs.select(*keep, let(words, of_words).alias("w"), per_line.alias("l"), counted.alias("c"))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    rows = rows.withColumns({"n_words": F.col("w.n"), "word_chars": F.col("w.chars"), "n_repeat_words": F.col("w.repeated"), "n_dup_lines": F.col("l.again"), "distinct": F.col("w.distinct"), "n_lines": F.col("l.n")} | {name: F.col(f"c.{name}") for name in KINDS})
    return rows.withColumns(
        {
            "s_words": F.log2(F.col("n_words") + 1), "s_word_length": share("word_chars", "n_words"), "s_symbols": share("n_symbols", "word_chars"), "s_dup_lines": share("n_dup_lines", "n_lines"),
            "s_repeats": share("n_repeat_words", "n_words"), "s_distinct": share("distinct", "n_words"), "s_line": share("n_words", "n_lines"), "s_digits": share("digits", "word_chars"),
            "s_calls": share("calls", "n_words"), "s_stops": share("stops", "n_words"), "s_capitals": share("capitals", "word_chars"),
        }
    ).drop("w", "l", "c", "digits", "calls", "stops", "capitals", "distinct", "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Term:
    name: str
    above: bool
    limit: float

    def holds(self, row: dict) -> bool:
        return row[self.name] > self.limit if self.above else row[self.name] <= self.limit

    def column(self) -> Column:
        c = F.col(self.name)
        return c > F.lit(self.limit) if self.above else c <= F.lit(self.limit)

    def __str__(self):
        return f"{self.name} {'>' if self.above else '<='} {self.limit:.6g}"


def _split(rule, rows):
    return [r for r in rows if all(t.holds(r) for t in rule)]


def _counts(rows) -> tuple[int, int]:
    bad = sum(r["bad"] for r in rows)
    return bad, len(rows) - bad


def _thresholds(values: list[float]) -> list[float]:
    """Midpoints between neighbours at quantiles of the distinct values."""
    distinct = sorted(set(values))
    picks = range(len(distinct) - 1) if len(distinct) <= STEPS else [round(k * (len(distinct) - 2) / (STEPS - 1)) for k in range(STEPS)]
    return sorted({(distinct[k] + distinct[k + 1]) / 2 for k in picks})


def grow(rows: list[dict], names: list[str]) -> list[Term]:
    """Comparisons added one at a time by the information that they gain on bad rows, until none but bad ones are left."""
    rule: list[Term] = []
    while len(rule) < TERMS:
        p, n = _counts(rows)
        if not p or not n:
            break
        best = None
        for name in names:
            ordered = sorted((r[name], r["bad"]) for r in rows)
            limits, k, bad = _thresholds([v for v, _ in ordered]), 0, 0
            for limit in limits:
                while k < len(ordered) and ordered[k][0] <= limit:
                    bad += ordered[k][1]
                    k += 1
                for above, (p1, n1) in ((False, (bad, k - bad)), (True, (p - bad, n - k + bad))):
                    if p1 >= SUPPORT:
                        gain = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p / (p + n)))
                        if gain > 1e-9 and (best is None or gain > best[0]):
                            best = (gain, Term(name, above, limit))
        if best is None:
            break
        rule.append(best[1])
        rows = _split([best[1]], rows)
    return rule


def prune(rule: list[Term], rows: list[dict]) -> list[Term]:
    """The beginning of the rule that is best on other rows, without comparisons that a later one implies."""

    def value(k):
        p, n = _counts(_split(rule[:k], rows))
        return ((p - n) / (p + n) if p + n else -1.0, -k)

    kept = rule[: max(range(1, len(rule) + 1), key=value)]
    return list({(t.name, t.above): t for t in kept}.values())


def cover(rows: list[dict], names: list[str]) -> list[list[Term]]:
    """The decision list: rules in order, each learned on the rows that those before don't cover.

    rows: statistics with `bad` (0 or 1) and `part` (whether a row is for growing). It stops where no rule is sure enough.
    """
    out: list[list[Term]] = []
    while len(out) < RULES:
        growing, pruning = [r for r in rows if r["part"]], [r for r in rows if not r["part"]]
        rule = grow(growing, names)
        if not rule:
            break
        rule = prune(rule, pruning)
        p, n = _counts(_split(rule, rows))
        if p < SUPPORT or p < PRECISION * (p + n):
            break
        out.append(rule)
        rows = [r for r in rows if not all(t.holds(r) for t in rule)]
    return out


def verdict(rules: list[list[Term]]) -> Column:
    """Whether a text is kept, by the first rule that holds."""
    out = None
    for rule in rules:
        condition = rule[0].column()
        for term in rule[1:]:
            condition = condition & term.column()
        out = F.when(condition, F.lit(False)) if out is None else out.when(condition, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Term]]:
    """Rules for texts of low quality, from labels (doc_id, quality 0 or 1).

    About `sample` labelled rows are used, those whose hashed ids are lowest (all, if there are fewer): the bound of what
    is learned from, and of what comes to the driver, which are numbers only. Labels with nulls are left out; texts that
    fail the base rules don't teach. Without bad rows there are no rules.
    """
    with scratch(docs.sparkSession):
        return _learned(docs, labels, sample)


def _learned(docs: DataFrame, labels: DataFrame, sample: int) -> list[list[Term]]:
    marked = labels.select("doc_id", "quality").filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, sample / max(1, marked.count()))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    marked = marked.filter(place < share)  # about `sample` rows, so they may be broadcast
    chosen = materialize(docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id"), "quality-sample")
    rows = statistics(chosen, "doc_id", "quality").filter(~base_failed())
    names = sorted(c for c in rows.columns if c.startswith("s_"))
    got = rows.select((1 - F.col("quality")).alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) > 0).alias("part"), *names).collect()
    return cover(sorted((r.asDict() for r in got), key=lambda r: tuple(r.values())), names)


def judged(docs: DataFrame, rules: list[list[Term]], *keep: str) -> DataFrame:
    """The `keep` columns of docs with the counts, base_failed and kept.

    A null or empty text has no words and fails. Repeated rows are judged alike. Texts are whole, of any length.
    Columns that aren't kept are not looked at. An empty table gives no rows.
    """
    rows = statistics(docs, *keep).withColumn("base_failed", base_failed())
    return rows.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rules = learn(docs, table(spark, sf_dir, "labels"))
    return judged(docs, rules, "doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
