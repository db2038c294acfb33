import random

import pytest

#: Schema of documents with a column more, whose names clash with those that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank long, blob_id string, n long"


def prose(seed: int, words: int, vocabulary: int = 300) -> str:
    r = random.Random(seed)
    made = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(r.choice(made) for _ in range(words))


@pytest.fixture(scope="session")
def make_docs(spark, tmp_path_factory):
    """make_docs(texts) writes documents.parquet in a new folder and returns (folder, DataFrame)."""

    def make(texts, ids=None, langs=None, sources=None):
        at = str(tmp_path_factory.mktemp("docs"))
        rows = []
        for k, text in enumerate(texts):
            lang = langs[k] if langs else ["en", "de", None][k % 3]
            source = sources[k] if sources else ["a", "b", None][k % 3]
            rows.append((ids[k] if ids else k, text, lang, source, None if text is None else len(text), 7, None, "x", k))
        df = spark.createDataFrame(rows, SCHEMA)
        df.coalesce(2).write.mode("overwrite").parquet(f"{at}/documents.parquet")
        return at, spark.read.parquet(f"{at}/documents.parquet")

    return make
