"""The corpus pipeline: five stages in order, each written and read again by the next.

A stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns that docs has,
whatever they are called, with the types they have. A table without rows gives one without rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe_codec, jaccard_join, mixing, secret_scans, toxicity
from ledgerlens.llm.language_id import held_out
from ledgerlens.llm.shared import documents, materialize, new_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the lexicon is learned from labelled documents outside the held-out third.

    Null and empty texts have the score of no match and stay. Repeated rows go or stay alike. Texts are whole.
    """
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 3, 1))
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "text")  # so that no name clashes
    scored = toxicity.score(whole, toxicity.learn(docs, labels), "_row")
    return scored.filter(F.col("toxicity") < toxicity.THRESHOLD).select("_row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of linked ones.

    Null, empty and wordless texts link with nothing and stay, each row by itself. Null ids come after all, and of rows
    with equal ids any one is first. Texts are whole.
    """
    return jaccard_join.without_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts masked, and n_chars as the text is then.

    Null texts stay null, and their n_chars as it is. Repeated rows are masked alike. Texts are whole.
    """
    return secret_scans.redacted(docs, secret_scans.Ledger(spark, new_path(spark, "secret-ledger")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, or up to three equal rows.

    A null source is a source, a null text has no words. Rows with one id are taken together.
    """
    return mixing.realised(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and token_ids of every row; a null text is an empty one."""
    return bpe_codec.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), "doc_id", with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_copies),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Scores are learned, so SQL can't express the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
