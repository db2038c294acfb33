"""BPE encoding and decoding of documents, by the transducer of bpe.py."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import arrow, bpe
from .shared import documents
from .words import spread


def described(path: str) -> str:
    """A tokenizer file's text, read where the job starts; it goes to the executors with the tasks (a few MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def merges_of(text: str) -> bpe.Merges:
    return arrow.once(("merges", hash(text)), lambda: bpe.Merges(text))


def encoder_of(text: str) -> bpe.Encoder:
    """The worker's encoder, which knows the words of all that the worker has read, up to its bound."""
    return arrow.once(("encoder", hash(text)), lambda: bpe.Encoder(merges_of(text)))


def _id_lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """The `keep` columns of docs with token_ids, an array of int. A null or empty text has none."""
    shared = docs.sparkSession.sparkContext.broadcast(described(path))

    def run(batches):
        encoder = encoder_of(shared.value)
        for part, texts in arrow.slices(batches, most=encoder.PART):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), _id_lists(*encoder.ids(texts))], [*keep, "token_ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return arrow.map_texts(docs.select(*keep, "text"), run, f"{fields}, token_ids array<int>")


class _Numbers:
    """Ids in decimal with a comma behind each, as one array of bytes."""

    def __init__(self, size: int):
        each = [b"%d," % k for k in range(size)]
        self.blob, self.width = np.frombuffer(b"".join(each), dtype=np.uint8), np.array([len(x) for x in each], dtype=np.int64)
        self.place = np.cumsum(self.width) - self.width


class _Seen:
    """What is known of a text whose ids come in stretches: their number and the digests of names and of decoded text."""

    def __init__(self, merges: bpe.Merges):
        self.n, self.decoder, self.named, self.decoded = 0, bpe.Decoder(merges), hashlib.sha256(), hashlib.sha256()

    def take(self, n: int, names: np.ndarray, raw: np.ndarray) -> None:
        if n:
            self.named.update(b"," if self.n else b"")
            self.named.update(names[:-1])  # but for the last comma
            self.decoded.update(self.decoder.take(raw.tobytes()).encode())
            self.n += n

    def row(self) -> tuple[int, str, str]:
        self.decoded.update(self.decoder.finish().encode())
        return self.n, self.named.hexdigest(), self.decoded.hexdigest()


def round_trip(docs: DataFrame, path: str, *keep: str, with_ids: bool = False) -> DataFrame:
    """The `keep` columns with n_tokens, ids_sha256 (of decimal ids, comma-joined) and decoded_sha256, and token_ids if asked for.

    A null text is an empty one: no tokens, hashes of nothing. A name of a special token in a text is that token, as
    the tokenizer file has it. A long text goes through the transducer a part at a time, and its ids to the digests and
    the decoder as they come; only token_ids holds all of them. Copies and repeated rows are encoded each by itself, from
    words kept in a bounded table. The kept columns may have any names but those three (and token_ids, if asked for). An
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(described(path))

    def run(batches):
        merges, encoder = merges_of(shared.value), encoder_of(shared.value)
        names = arrow.once(("names", merges.size), lambda: _Numbers(merges.size))
        for part, texts in arrow.slices(batches, most=encoder.PART):
            seen, whole = [_Seen(merges) for _ in texts], [[] for _ in texts] if with_ids else None
            for places, ids, counts in encoder.stream(texts):
                ends = np.cumsum(counts)
                wide, width = np.append(0, np.cumsum(names.width[ids])), np.append(0, np.cumsum(merges.width[ids]))
                written, raw = spread(names.blob, names.place[ids], names.width[ids]), merges.bytes_of(ids)
                for k, a, b in zip(places, (ends - counts).tolist(), ends.tolist(), strict=True):
                    seen[k].take(b - a, written[wide[a] : wide[b]], raw[width[a] : width[b]])
                    if with_ids:
                        whole[k].append(ids[a:b])
            made = [pa.array(x, t) for x, t in zip(zip(*(s.row() for s in seen), strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
            if with_ids:
                made.append(_id_lists(np.concatenate([x for each in whole for x in each]), np.array([sum(map(len, each)) for each in whole])))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], [*keep, "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"][: len(keep) + len(made)])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return arrow.map_texts(docs.select(*keep, "text"), run, f"{fields}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the byte-level vocabulary of 50,257 ids."""
    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), "doc_id")
