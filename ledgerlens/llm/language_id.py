"""Language identification by unigram pieces, with every segmentation summed.

A word's probability in a language is the sum, over all ways to cut it into pieces of a fixed public vocabulary, of the
product of the pieces' probabilities; the forward algorithm gives it, in logarithms, for words of any length. A text is
its words (runs of letters and their marks, lower case). Piece probabilities are learned by expectation and
maximisation: expected counts by the forward and backward sums, on a bounded sample of labelled documents.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrow
from .shared import documents, scratch
from .words import LETTER, MARK, WordTable, classes, joined

#: Documents of each language that are learned from, in expectation; rounds of learning; the count added to each piece;
#: letters of the longest word that is learned from (there is no bound on those that are scored).
SAMPLE, ROUNDS, ADDED, LEARNED = 1500, 3, 0.02, 256
#: Letters of the longest piece.
PIECE = 16
#: Words whose scores are kept, and scores of all of them; places in words, times languages, that are looked at together;
#: places of one word that are.
KEPT, SCORES, TOGETHER, STRETCH = 1_600_000, 1 << 24, 1 << 18, 1 << 13


def word_places(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, lower case, where words begin and end in them, and how many words each text has.

    A word is a run of letters and marks with a letter.
    """
    raw = [t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    data, edges = joined(raw)
    kind = classes(data[: edges[-1]])
    inside = (kind == LETTER) | (kind == MARK)
    turns = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begin, end = turns[::2], turns[1::2]
    letters = np.append(0, np.cumsum(kind == LETTER))
    some = letters[end] > letters[begin]
    begin, end = begin[some], end[some]
    return data, begin, end, np.diff(np.searchsorted(begin, edges))


def words_of(text: str) -> list[str]:
    data, begin, end, _ = word_places([text])
    return [data[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def vocabulary(path: str) -> list[str]:
    """The plain pieces of a sentencepiece model, with the mark of a word's beginning."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    return [model.id_to_piece(k) for k in range(n) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]


class Trie:
    """The pieces as a tree of letters, followed for many places at once. ids: numbers of pieces, from 1."""

    def __init__(self, ids: dict[str, int]):
        nodes: dict[tuple[int, str], int] = {}
        piece = [-1]
        for s, k in ids.items():
            at = 0
            for c in s[:PIECE]:
                at = nodes.setdefault((at, c), len(piece))
                if at == len(piece):
                    piece.append(-1)
            if len(s) <= PIECE:
                piece[at] = k
        self.piece, self.size = np.array(piece, dtype=np.int32), 2 + max(ids.values(), default=0)
        self.table = WordTable()
        keys = np.array([at << 21 | ord(c) for at, c in nodes], dtype=np.uint64)
        self.table.insert(keys, np.zeros_like(keys), np.array(list(nodes.values()), dtype=np.int32))

    def arcs(self, letters: np.ndarray) -> np.ndarray:
        """piece[place, size - 1, word]: the piece of this size that ends at the place, size - 1 of the table for none.

        letters: code points, a row for each word, all of one length. Piece 0 is any other single letter.
        """
        words, n = letters.shape
        most = min(PIECE, n)
        out = np.full((n + 1, most, words), self.size - 1, dtype=np.int32)
        flat = np.ascontiguousarray(letters).ravel().astype(np.uint64)
        at, word = (x.ravel() for x in np.indices((n, words)))
        node = np.zeros(len(word), dtype=np.int64)
        for size in range(1, most + 1):
            if size > 1:
                inside = (node >= 0) & (at + size <= n)
                at, word, node = at[inside], word[inside], node[inside]
            key = (node.astype(np.uint64) << np.uint64(21)) | flat[word * n + at + size - 1]
            node = self.table.find(key, np.zeros_like(key)).astype(np.int64)
            piece = np.where(node >= 0, self.piece[node], -1)
            if size == 1:
                piece = np.maximum(piece, 0)
            there = piece >= 0
            out[at[there] + size, size - 1, word[there]] = piece[there]
        return out


def forward(arcs: np.ndarray, p: np.ndarray, known: np.ndarray) -> np.ndarray:
    """sums[place, word, language]: the logarithm of the probability of the word up to a place.

    p: of pieces by language, with 0 for no piece. known: the sums of the first places. Sums are kept as numbers that
    are divided by the last one at every PIECE places, which no piece is longer than.
    """
    places, most, words = arcs.shape
    begin = len(known)
    out, scale = np.empty((places, words, p.shape[1])), known[-1]
    out[:begin] = np.exp(known - scale)
    logs = np.empty_like(out)
    logs[:begin] = known
    done = begin
    for t in range(begin, places):
        k = min(t, most)
        out[t] = (out[t - k : t][::-1] * p[arcs[t, :k]]).sum(0)
        if t - done + 1 == PIECE or t == places - 1:
            logs[done : t + 1] = np.log(out[done : t + 1]) + scale
            scale = logs[t]
            out[max(0, t - PIECE + 1) : t + 1] = np.exp(logs[max(0, t - PIECE + 1) : t + 1] - scale)
            done = t + 1
    return logs


def backward(arcs: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The same of the word from a place on: the word is read from its end."""
    places, most, _ = arcs.shape
    turned = np.full_like(arcs, len(p) - 1)
    for size in range(1, most + 1):
        turned[size:, size - 1] = arcs[size:, size - 1][::-1]
    return forward(turned, p, np.zeros((1, arcs.shape[2], p.shape[1])))[::-1]


class Lattice:
    """The ways to cut many words into pieces. Words of one length are looked at together, a bounded number at a time."""

    def __init__(self, words: list[str], pieces, together: int = TOGETHER):
        self.words, self.trie, self.together = ["▁" + w for w in words], pieces if isinstance(pieces, Trie) else Trie(pieces), together

    def _groups(self):
        """The places of words of one length, and their arcs."""
        length = np.array([len(w) for w in self.words])
        order = np.argsort(length, kind="stable")
        edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
        for a, b in zip(edges, edges[1:], strict=False):
            n = int(length[order[a]])
            step = max(1, self.together // (n + 1))
            for k in range(a, b, step):
                at = order[k : min(b, k + step)]
                text = "".join(map(self.words.__getitem__, at.tolist()))
                yield at, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(at), n)

    def log_totals(self, p: np.ndarray) -> np.ndarray:
        """The logarithm of each word's probability in each language. p: with 0 for no piece."""
        out = np.empty((len(self.words), p.shape[1]))
        for at, letters in self._groups():
            known = np.zeros((1, len(at), p.shape[1]))
            for k in range(0, letters.shape[1], STRETCH):  # a stretch needs the sums of the PIECE places before it only
                sums = forward(self.trie.arcs(letters[:, max(0, k - PIECE + 1) : k + STRETCH]), p, known)
                known = sums[-PIECE:]
            out[at] = sums[-1]
        return out

    def totals(self, p: np.ndarray) -> np.ndarray:
        return np.exp(self.log_totals(with_none(p)))

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected counts of all pieces in words with these counts; p: of one language, a column."""
        whole, out = with_none(p), np.zeros(len(p) + 1)
        for at, letters in self._groups():
            arcs = self.trie.arcs(letters)
            ahead, back = forward(arcs, whole, np.zeros((1, len(at), 1)))[..., 0], backward(arcs, whole)[..., 0]
            end, size, word = np.nonzero(arcs < len(p))
            piece = arcs[end, size, word]
            use = whole[piece, 0] * np.exp(ahead[end - size - 1, word] + back[end, word] - ahead[-1, word])
            out += np.bincount(piece, use * counts[at][word], minlength=len(out))
        return out[:-1]


def with_none(p: np.ndarray) -> np.ndarray:
    """Probabilities with a row of 0 for no piece."""
    return np.concatenate([p, np.zeros((1, p.shape[1]))])


@dataclass
class Model:
    """languages, piece probabilities (piece by language) and the log of each language's share."""

    pieces: list[str]
    languages: list[str]
    p: np.ndarray
    prior: np.ndarray
    trie: Trie = field(init=False)

    def __post_init__(self):
        self.trie, self.whole = Trie({s: k + 1 for k, s in enumerate(self.pieces)}), with_none(self.p)
        self.table, self.scores = WordTable(), np.zeros((1 << 12, len(self.languages)))

    def text_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The log probability of each text's words in each language, with its share, and how many words each has."""
        data, begin, end, counts = word_places(texts)
        if self.table.n > min(KEPT, SCORES // len(self.languages)):
            self.table.clear()
        known = self.table.n
        rows, new = self.table.rows(data, begin, end)
        if len(new):
            words = [data[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)]
            if self.table.n > len(self.scores):  # doubled, so that rows are copied seldom
                grown = np.empty((max(self.table.n, 2 * len(self.scores)), len(self.languages)))
                grown[:known] = self.scores[:known]
                self.scores = grown
            self.scores[known : self.table.n] = Lattice(words, self.trie, TOGETHER // len(self.languages)).log_totals(self.whole)
        out = np.tile(self.prior, (len(texts), 1))
        some = np.flatnonzero(counts)
        if len(some):
            out[some] += np.add.reduceat(self.scores[rows], (np.cumsum(counts) - counts)[some])
        return out, counts


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text, modulo parts, is part; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def learn(rows: DataFrame, path: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model | None:
    """A model from rows with text and a non-null lang; None where no row has a letter.

    About `sample` documents of each language are used, those whose hashed ids are lowest (all, if there are fewer):
    the bound of what is learned from. Words are counted once; expected counts are summed on the executors, a row for
    each language and piece.
    """
    rows = rows.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return None
    share = F.create_map(*[F.lit(x) for g in languages for x in (g, min(1.0, sample / sizes[g]))])
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    spark = rows.sparkSession
    n = min(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chosen = rows.filter(place < F.element_at(share, F.col("lang"))).select("text", "lang")
    pieces = vocabulary(path)
    p = np.full((len(pieces) + 1, len(languages)), 1 / (len(pieces) + 1))
    index = {g: k for k, g in enumerate(languages)}

    def words(batches):
        for part, texts in arrow.slices(batches):
            counts = Counter()
            for text, g in zip(texts, part.column("lang").to_pylist(), strict=True):
                counts.update((index[g], w) for w in words_of(text) if len(w) <= LEARNED)
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in counts], pa.int32()), pa.array([w for _, w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["g", "word", "n"])

    with scratch(spark) as keep:
        counted = arrow.map_texts(chosen, words, "g int, word string, n long").groupBy("g", "word").agg(F.sum("n").alias("n"))
        counted = keep(counted.repartition(n), "language-words")  # bounded, and each round is much work for its size
        for _ in range(rounds):
            now = spark.sparkContext.broadcast(p)

            def count(batches, now=now):
                trie = arrow.once(("trie", path), lambda: Trie({s: k + 1 for k, s in enumerate(pieces)}))
                total = np.zeros(now.value.shape)
                for batch in batches:
                    g, w, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "word", "n"))
                    for x in np.unique(g).tolist():
                        total[:, x] += Lattice(w[g == x].tolist(), trie).expected(now.value[:, [x]], k[g == x].astype(float))
                piece, x = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[piece, x])], ["g", "piece", "n"])

            found = counted.mapInArrow(count, "g int, piece int, n double").groupBy("g", "piece").agg(F.sum("n").alias("n")).toPandas()
            counts = np.full(p.shape, ADDED)
            np.add.at(counts, (found["piece"].to_numpy(), found["g"].to_numpy()), found["n"].to_numpy())
            p = counts / counts.sum(0)
            now.unpersist()
    total = np.array([sizes[g] for g in languages], dtype=float)
    return Model(pieces, languages, p, np.log(total / total.sum()))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score (the language's probability by the model) of every document.

    A null, empty or letterless text is `und` with score 0, and so is every text where nothing could be learned.
    Repeated rows are predicted alike. Texts and words are whole, of any length. Of languages with equal scores the
    first by code point is predicted. Other columns are not looked at. An empty table gives no rows. A worker keeps the
    scores of words that it has met, up to a bound.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((model.pieces, model.languages, model.p, model.prior))
    name = uuid.uuid4().hex

    def run(batches):
        mine = arrow.once(("language", name), lambda: Model(*shared.value))
        for part, texts in arrow.slices(batches):
            scores, counts = mine.text_scores(texts)
            best = scores.argmax(1)
            sure = 1 / np.exp(scores - scores.max(1, keepdims=True)).sum(1)
            names = [mine.languages[b] if n else "und" for b, n in zip(best, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(counts > 0, sure, 0.0))], ["doc_id", "lang_pred", "score"])

    return arrow.map_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = held_out(F.col("doc_id"), 5, 0)
    model = learn(docs.filter(~out), public_tokenizers.path("piece_bpe_32k.model"))
    return predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
