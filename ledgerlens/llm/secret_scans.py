"""Secret scans: an incremental ledger of text blobs, in DataFrame functions only.

Every version of every text is a blob, named by the SHA-256 of its UTF-8 bytes. The ledger has a row for each pair of
blob and rule version that has been scanned, with the spans found. A run scans only the pairs that the ledger lacks,
appends them, and joins findings back to every path that holds the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, let, new_path, scratch

SPANS = "array<struct<start:int,kind:int,stop:int>>"
#: Matches that are put together at once.
PART = 256


@dataclass(frozen=True)
class Rule:
    """A pattern (Java regular expression); `body` names a group that must have `least` characters."""

    name: str
    version: str
    pattern: str
    body: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: For hex and access the run of a class is as long as it can be, so a least length in the pattern is the same as a test of each run.
RULES = (
    Rule("assign", "1", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "1", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", "1", r"[0-9a-f]{24,}"),
)


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def spans(text: Column, rule: Rule, kind: int) -> Column:
    """The matches of a rule, as (start, kind, stop) in code points, stop exclusive.

    The text between matches and the matches themselves have lengths whose running sum gives the places.
    """
    pattern = F.lit(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    body = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.body)), F.length) if rule.body else found
    pairs = F.arrays_zip(between.alias("gap"), found.alias("size"), body.alias("body"))

    def step(done, x):
        first = done["at"] + x["gap"]
        stop = first + F.coalesce(x["size"], F.lit(0))
        one = F.array(F.struct(first.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop")))
        good = x["size"].isNotNull() & (x["body"] >= rule.least)
        return F.struct(stop.alias("at"), F.when(good, F.concat(done["out"], one)).otherwise(done["out"]).alias("out"))

    # appended to short arrays, which are put together at the end: many matches don't copy what is there again and again
    def put(p: Column) -> Column:
        part = lambda done, k: F.aggregate(F.slice(p, k, PART), F.struct(done["at"].alias("at"), F.array().cast(SPANS).alias("out")), step)
        merge = lambda done, k: let(part(done, k), lambda x: F.struct(x["at"].alias("at"), F.concat(done["out"], F.array(x["out"])).alias("out")))
        parts = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1)), F.lit(PART)), parts, merge, lambda done: F.flatten(done["out"]))

    every = let(pairs, put)
    return F.when(text.rlike(rule.pattern), every).otherwise(F.array().cast(SPANS))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """Ledger rows (blob_id, rule, spans) for the pairs of blob and rule version that the ledger lacks.

    versions: any rows with `text` (null: empty). Copies meet by blob, after each task has dropped its own; texts of
    blobs that were scanned before under every rule are dropped before any pattern runs.
    """
    blobs = versions.select(blob_id(F.col("text")).alias("blob_id"), F.coalesce("text", F.lit("")).alias("text"))
    blobs = blobs.groupBy("blob_id").agg(F.first("text").alias("text"))
    keys = [r.key for r in rules]
    if ledger is not None:
        seen = ledger.filter(F.col("rule").isin(keys)).groupBy("blob_id").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob_id", "left")
    else:
        blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
    unseen = lambda r: ~F.coalesce(F.array_contains("seen", r.key), F.lit(False))
    each = [F.when(unseen(r), F.struct(F.lit(r.key).alias("rule"), spans(F.col("text"), r, k).alias("spans"))) for k, r in enumerate(rules)]
    rows = blobs.select("blob_id", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x"))
    return rows.select("blob_id", "x.rule", "x.spans")


class Ledger:
    """The scanned pairs, as a Parquet table that only grows. Two writers may append the same pairs: they are read as one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
        return self.spark.read.schema(f"blob_id binary, rule string, spans {SPANS}").parquet(self.path) if there else None

    def scan(self, versions: DataFrame, rules=RULES) -> DataFrame:
        """Scans what is new in versions, and returns the whole ledger."""
        scan_unseen(versions, self.read(), rules).write.mode("append").parquet(self.path)
        return self.read()


def findings_of(ledger: DataFrame, rules=RULES) -> DataFrame:
    """blob_id and found: all spans under the present rule versions by start, then rule; blobs with findings only."""
    present = ledger.filter(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0))
    return present.groupBy("blob_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("found"))


def secrets(versions: DataFrame, ledger: Ledger, rules=RULES, keep: tuple[str, ...] = ("doc_id",), news: Column | None = None) -> DataFrame:
    """Every row of versions (its `keep` columns) with blob_id and found, an array of (start, kind, stop), maybe empty.
    news: the rows that the ledger may not have had; all, if it isn't given.

    A null text is an empty one. Repeated rows each get their findings. An empty table gives no rows. Other columns
    of versions are not looked at. Texts are whole, of any length; of matches of one rule that begin at one place there
    is one, and spans of several rules that tie stand in the order of rules. A blob held by a third of all paths is a hot key of the last join only, whose large
    side Spark may split.
    """
    found = findings_of(ledger.scan((versions if news is None else versions.filter(news)).select("text"), rules), rules)
    paths = versions.select(*keep, blob_id(F.col("text")).alias("blob_id"))
    return paths.join(found, "blob_id", "left").withColumn("found", F.coalesce("found", F.array().cast(SPANS)))


def redact(text: Column, found: Column, mask: str = "[REDACTED]") -> Column:
    """The text with the union of the spans replaced by a mask; spans are sorted by start."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(done, x):
        gap = F.when(x["start"] >= done["at"], F.array(F.substring(text, done["at"] + 1, x["start"] - done["at"]), F.lit(mask)))
        return F.struct(F.greatest(done["at"], x["stop"]).alias("at"), F.concat(done["out"], F.coalesce(gap, F.array().cast("array<string>"))).alias("out"))

    rest = lambda done: F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.length(text)))
    return F.when(F.size(found) > 0, F.aggregate(found, begin, step, rest)).otherwise(text)


def redacted(docs: DataFrame, ledger: Ledger) -> DataFrame:
    """docs with what was found masked in their texts, and n_chars made the length of those that changed; null texts stay."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    rows = secrets(whole, ledger, keep=("_row", "text"))
    text = F.when(F.col("text").isNotNull(), redact(F.col("text"), F.col("found")))
    row = F.col("_row").withField("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(F.size("found") > 0, F.length(text).cast(kind)).otherwise(F.col("_row.n_chars")))
    return rows.select(row.alias("_row")).select("_row.*")


def described(found: Column, rules=RULES) -> Column:
    names = F.array(*[F.lit(r.name) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the findings in documents; the ledger adds no spans of its own, so all spans are the base ones.

    Documents come in two increments, so the second scans only texts that the first hasn't had.
    """
    docs = documents(spark, sf_dir)
    with scratch(spark) as keep:
        ledger = Ledger(spark, new_path(spark, "secret-ledger"))
        early = F.xxhash64("doc_id") % 2 == 0
        ledger.scan(docs.filter(early).select("text"))
        return keep(_digests(secrets(docs, ledger, news=~early)), "secrets")


def _digests(rows: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    rows = rows.select("doc_id", *[count(k).alias(f"n_{r.name}") for k, r in enumerate(RULES)], described(F.col("found")).alias("spans"), F.lower(F.hex("blob_id")).alias("blob"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"), "spans", "blob")
