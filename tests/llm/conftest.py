import pandas as pd
import pytest

CLASHING = ("class", "n", "rid", "train", "place", "bucket", "carried", "held_out", "score", "toxicity_score", "fingerprint", "n_tokens", "label", "task", "group", "lang", "source", "n_chars")
LONG = "long tale of many words and more " * 9000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 3),
    (2, None),
    (3, ""),
    (4, "The quick brown fox jumps over the lazy dog. " * 3),
    (4, "The quick brown fox jumps over the lazy dog. " * 3),
    (5, " \n\t "),
    (6, "één ñandú — 日本語のテキスト 😀 <|endoftext|> it's 'll"),
    (None, "a row without an id"),
    (None, None),
    (7, "x" * 5000),
    (8, LONG),
    (9, "!?"),
    (10, "one two"),
    (11, "ONE two"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty, blank and long texts, ties, repeats, and clashing columns."""
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(d, t, *(["en"] * len(CLASHING))) for d, t in ROWS], f"doc_id long, text string, {extra}")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (4, 0, 1), (4, 1, None), (6, None, 0), (None, 1, 1), (8, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small(sf):
    """The smallest documents table, in pandas."""
    return pd.read_parquet(f"{sf}/documents.parquet")
