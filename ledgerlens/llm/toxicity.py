"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding writes look-alike letters of other scripts and digits that stand for letters as the letter meant. A text that has
marks on letters or compatible forms is read a second time without them: what it says with them counts too, since words
of many languages differ by marks alone. Entries of the
lexicon are beginnings of words, with weights learned from labelled documents; phrases in which an entry is harmless
are exceptions, and matches inside them don't count. The weights matched, as they are and per hundred words, give the
score by a logistic function, fitted on the same documents.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import arrow
from .language_id import held_out
from .shared import documents, materialize, scratch, table

#: Labelled documents that are learned from, in expectation; entries kept at most.
SAMPLE, ENTRIES = 20_000, 4_000
#: Letters of an entry; toxic documents that must have it; and, as if both kinds were equally many, the least share of
#: toxic ones among those that do: for a candidate, and for an entry once exceptions don't count.
SHORTEST, LONGEST, SUPPORT, CANDIDATE, PRECISION = 4, 12, 8, 0.75, 0.98
#: Harmless phrases with words that insult elsewhere. Fixed values; more are learned.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clown car", "circus clown", "pond scum", "soap scum", "sore loser law")
THRESHOLD = 0.7

#: Letters of other scripts that look like Latin ones. Fixed values.
LOOKALIKES = {
    "a": "аαɑ", "b": "ьβ", "c": "сϲ", "d": "ԁđð", "e": "еε", "h": "һħ", "i": "іıι", "j": "ј", "k": "кκ", "l": "ł", "m": "м", "n": "ո", "o": "оοօø",
    "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτŧ", "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγү",
}
#: Digits and signs written for letters. Fixed values. What is written for i is written for l too, so both fold to i.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "l": "i"}
UNSEEN = "­​‌‍⁠﻿"


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {ord(c): None for c in UNSEEN}
    out |= {ord(c): SUBSTITUTES.get(latin, latin) for latin, others in LOOKALIKES.items() for c in others}
    out |= {ord(c): latin for c, latin in SUBSTITUTES.items()}
    for c in range(0xFF01, 0xFF5F):  # full width
        plain = unicodedata.normalize("NFKC", chr(c)).lower()
        out[c] = SUBSTITUTES.get(plain, plain)
    return out


FOLD = _table()
BARE = FOLD | {c: None for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M"}
INNER = re.compile(r"(?<=[^\W\d_])!(?=[^\W\d_])")
WORDS = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case, look-alikes and substitutes as letters; a ! between letters is an i."""
    return _inner(text.lower().translate(FOLD))


def _inner(text: str) -> str:
    return INNER.sub("i", text) if "!" in text else text


def bare(text: str) -> str:
    """fold, of the text without marks and with compatible forms as plain letters."""
    return _inner(unicodedata.normalize("NFKD", text.lower()).lower().translate(BARE))


def forms(text: str) -> list[str]:
    """The ways in which a text is read: folded, and bare where that is another."""
    out = [fold(text)]
    if not text.isascii():
        out += [b for b in [bare(text)] if b != out[0]]
    return out


@dataclass
class Lexicon:
    """weights of entries (folded beginnings of words), folded exception phrases, and the logistic's coefficients."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float] = (-4.0, 2.0, 1.0)

    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for phrase in self.exceptions:
            made.add_word(phrase, (len(phrase), None))
        for entry, weight in self.weights.items():
            made.add_word(entry, (len(entry), weight))
        made.make_automaton()
        return made


def matches(folded: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the entries that begin a word and lie in no exception; of one word the longest."""
    best: dict[int, tuple[int, float]] = {}
    free: list[tuple[int, int]] = []
    if not len(automaton):
        return []
    for last, (size, weight) in automaton.iter(folded):
        start = last + 1 - size
        if start and folded[start - 1].isalnum():
            continue
        if weight is None:
            if last + 1 == len(folded) or not folded[last + 1].isalnum():
                free.append((start, last + 1))
        elif start not in best or best[start][0] < last + 1:
            best[start] = (last + 1, weight)
    if not free:
        return [(a, b, w) for a, (b, w) in best.items()]
    free.sort()
    starts, ends = [x for x, _ in free], list(accumulate((y for _, y in free), max))  # how far those that begin so early reach

    def inside(a: int, b: int) -> bool:
        k = bisect_right(starts, a)
        return k > 0 and ends[k - 1] >= b

    return [(a, b, w) for a, (b, w) in best.items() if not inside(a, b)]


def features(text: str, automaton: ahocorasick.Automaton) -> tuple[float, float]:
    """Logarithms of the weights matched, and of the weights matched for each hundred words.

    An entry counts as often as in that form of the text that has it most often.
    """
    read = forms(text)
    found = [matches(folded, automaton) for folded in read]
    if len(read) == 1 or not found[1]:
        total = sum(w for _, _, w in found[0])
    else:
        counts = [Counter((folded[a:b], w) for a, b, w in m) for folded, m in zip(read, found, strict=True)]
        total = sum(w * n for (_, w), n in (counts[0] | counts[1]).items())
    if not total:
        return 0.0, 0.0
    return math.log1p(total), math.log1p(100 * total / max(1, len(WORDS.findall(read[0]))))


def _lexicon_rows(chosen: DataFrame) -> DataFrame:
    """entry, toxic and clean: how many documents of each kind have a word that begins so."""

    def run(batches):
        counts: dict[str, list[int]] = {}

        def out():
            rows = pa.array(list(counts), pa.string()), pa.array([v[0] for v in counts.values()], pa.int64()), pa.array([v[1] for v in counts.values()], pa.int64())
            counts.clear()
            return pa.RecordBatch.from_arrays([*rows], ["entry", "toxic", "clean"])

        for batch in batches:
            for part, texts in arrow.slices([batch]):
                for text, toxic in zip(texts, part.column("toxic").to_pylist(), strict=True):
                    found = {w[:k] for w in set(WORDS.findall(fold(text))) for k in range(SHORTEST, min(LONGEST, len(w)) + 1)}
                    for e in found:
                        counts.setdefault(e, [0, 0])[0 if toxic else 1] += 1
                if len(counts) > 150_000:
                    yield out()
        yield out()

    return arrow.map_texts(chosen, run, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _matched_rows(chosen: DataFrame, lexicon: Lexicon) -> DataFrame:
    """entry, toxic and clean: how many documents of each kind it matches outside exceptions."""
    shared = chosen.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions))

    def run(batches):
        automaton = Lexicon(*shared.value).automaton()
        for batch in batches:
            for part, texts in arrow.slices([batch]):
                counts: Counter[tuple[str, bool]] = Counter()
                for text, toxic in zip(texts, part.column("toxic").to_pylist(), strict=True):
                    counts.update({(folded[a:b], toxic) for folded in forms(text) for a, b, _ in matches(folded, automaton)})
                yield _by_kind("entry", counts)

    return arrow.map_texts(chosen, run, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _by_kind(name: str, counts: Counter) -> pa.RecordBatch:
    """Rows of (what, toxic or not) counts."""
    what = pa.array([k for k, _ in counts], pa.string())
    kinds = [pa.array([n if toxic == kind else 0 for (_, toxic), n in counts.items()], pa.int64()) for kind in (True, False)]
    return pa.RecordBatch.from_arrays([what, *kinds], [name, "toxic", "clean"])


def choose_entries(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Entries with weights (log odds) from (entry, toxic, clean) counts: of nested ones the longest that has nearly all of the shorter one's documents."""
    weights: dict[str, float] = {}
    kept: dict[str, int] = {}
    for entry, t, c in sorted(rows, key=lambda r: (len(r[0]), r[0])):
        odds = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        above = next((entry[:k] for k in range(len(entry) - 1, 0, -1) if entry[:k] in kept), None)
        if above is not None:
            if t < 0.95 * kept[above]:
                continue
            del kept[above], weights[above]
        kept[entry], weights[entry] = t, odds
    return weights


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Logistic regression by Newton's method with a ridge."""
    a = np.c_[np.ones(len(x)), x]
    b = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(b)), a.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, b))


def word_before(folded: str, start: int) -> str:
    """The word and the space that stand in front of a place, however long the word is; empty if there is none."""
    begin = start - 1
    if begin < 1 or folded[begin] != " ":
        return ""
    while begin and folded[begin - 1].isalnum():
        begin -= 1
    return folded[begin:start] if begin < start - 1 else ""


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from the texts of docs that labels marks (toxic 0 or 1).

    About `sample` labelled documents are used, those whose hashed ids are lowest (all, if there are fewer): the bound of
    what is learned from. Counts are summed on the executors; at most ENTRIES candidates come to the driver. Labels with
    nulls are left out. Without toxic and clean documents the lexicon is empty.
    """
    with scratch(docs.sparkSession):
        return _learned(docs, labels, sample)


def _learned(docs: DataFrame, labels: DataFrame, sample: int) -> Lexicon:
    marked = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, marked.count()))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    marked = marked.filter(place < share)  # about `sample` rows, so they may be broadcast
    chosen = materialize(docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("text", (F.col("toxic") == 1).alias("toxic")), "toxic-sample")
    kinds = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    exceptions = tuple(map(fold, EXCEPTIONS))
    if len(kinds) < 2:
        return Lexicon({}, exceptions, (-4.0, 0.0, 0.0))
    toxic, clean = kinds[True], kinds[False]
    least = max(3, min(SUPPORT, toxic // 50))
    rate = F.col("toxic") / toxic / (F.col("toxic") / toxic + (F.col("clean") + 1) / (clean + 1))  # as if one clean document more had it
    rows = _lexicon_rows(chosen).withColumn("sure", rate >= PRECISION).filter((F.col("toxic") >= least) & (rate >= CANDIDATE))
    rows = rows.orderBy(F.desc("sure"), F.desc("toxic"), "clean", "entry").limit(ENTRIES).collect()
    sure, unsure = (choose_entries([r[:3] for r in rows if r["sure"] == kind], toxic, clean) for kind in (True, False))
    near = lambda e: any(e.startswith(x) or x.startswith(e) for x in sure)
    lexicon = Lexicon(sure | {e: w for e, w in unsure.items() if not near(e)}, exceptions)
    lexicon.exceptions += learn_exceptions(chosen, lexicon)
    rows = _matched_rows(chosen, lexicon).filter((F.col("toxic") >= least) & (rate >= PRECISION)).collect()
    lexicon.weights = {e: math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)) for e, t, c in sorted(rows)}
    shared = chosen.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions))

    def run(batches):
        automaton = Lexicon(*shared.value).automaton()
        for batch in batches:
            for part, texts in arrow.slices([batch]):
                x = [features(t, automaton) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array([v[0] for v in x]), pa.array([v[1] for v in x])], ["toxic", "a", "b"])

    got = arrow.map_texts(chosen, run, "toxic boolean, a double, b double").toPandas()
    lexicon.curve = fit_curve(got[["a", "b"]].to_numpy(), got["toxic"].to_numpy(dtype=float))
    return lexicon


def learn_exceptions(chosen: DataFrame, lexicon: Lexicon, least: int = 5) -> tuple[str, ...]:
    """Two-word phrases with an entry that several clean documents have and no toxic one."""
    shared = chosen.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions))

    def run(batches):
        automaton = Lexicon(*shared.value).automaton()
        after = re.compile(r"[^\W_]* [^\W_]+")
        for batch in batches:
            for part, texts in arrow.slices([batch]):
                counts: Counter[tuple[str, bool]] = Counter()
                for text, toxic in zip(texts, part.column("toxic").to_pylist(), strict=True):
                    folded = fold(text)
                    found = set()
                    for start, end, _ in matches(folded, automaton):
                        word = WORDS.match(folded, start)[0]
                        left, right = word_before(folded, start), after.match(folded, end)
                        found |= {left + word} if left else set()
                        found |= {folded[start:end] + right[0]} if right else set()
                    counts.update((f, toxic) for f in found)
                yield _by_kind("phrase", counts)

    summed = arrow.map_texts(chosen, run, "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rows = summed.filter((F.col("clean") >= least) & (F.col("toxic") == 0)).orderBy(F.desc("clean"), "phrase").limit(ENTRIES).collect()
    return tuple(r["phrase"] for r in rows)


def score(docs: DataFrame, lexicon: Lexicon, *keep: str, name: str = "toxicity") -> DataFrame:
    """The `keep` columns of docs with toxicity (0 to 1), under a name that none of them has.

    A null text is an empty one, which has the score of no match. Repeated rows score alike. Texts are whole. Columns
    that aren't kept are not looked at. An empty table gives no rows.
    """
    if name in keep:
        raise ValueError(f"{name} is a column that is kept")
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, lexicon.curve))

    def run(batches):
        mine = Lexicon(*shared.value)
        automaton, (c, a, b) = mine.automaton(), mine.curve
        for part, texts in arrow.slices(batches):
            x = np.array([features(t, automaton) for t in texts])
            y = 1 / (1 + np.exp(-np.clip(c + x @ np.array([a, b]), -500, 500)))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(y)], [*keep, name])

    extra = [] if "text" in keep else ["text"]
    schema = StructType([*docs.select(*keep).schema, StructField(name, DoubleType())])
    return arrow.map_texts(docs.select(*keep, *extra), run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = held_out(F.col("doc_id"), 3, 1)
    lexicon = learn(docs.filter(~out), table(spark, sf_dir, "labels").filter(~out))
    return score(docs, lexicon, "doc_id").select("doc_id", out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
