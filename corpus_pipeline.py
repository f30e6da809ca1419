"""A training-corpus pipeline of five stages over `documents`.

Each stage works on all that its predecessor kept and returns the columns of
documents, the last one the packed pieces:

1.  toxicity: documents scored 0.5 or more go; all stay if no labelled row is
    there to learn from.
2.  jaccard_join: documents link whose sets of five-word shingles have a Jaccard
    similarity of at least 0.8; of those linked, directly or in a chain, the one
    of the smallest id stays.
3.  suffix_dedup: passages of 50 bytes or more that a document of smaller id has
    too are cut out; a document of which nothing is left goes.  Bytes of a
    character that a cut splits go as well, and n_chars is counted anew.
4.  decontamination: documents that hold a window of a benchmark item go.
5.  packing: what is left is packed into sequences.

Null and empty texts, and in the first stage wordless ones, pass every filter.
Rows of a null id are never cut and never give way to a copy.  Rows that repeat
an id are one document: they are judged alike, stay or go together, are cut by
smaller ids only, and are packed row by row.  Of copies under several ids the
smallest id stays.  A text of any length is judged whole.  Empty tables give
empty results, with the same columns; further columns, whatever their names, are
dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import decontaminate, jaccard, packing, shared, suffix_dedup, toxicity

#: Of the jaccard_join stage.
SHINGLE, PERCENT = 5, 80

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"), judged="judged")
    return scored.where("toxicity_score < 0.5 or not judged").select(*COLUMNS)


def keep_one_of_linked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = jaccard.link_components(docs, percent=PERCENT, size=SHINGLE).where("doc_id != component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(docs, carry=("lang", "source", "n_chars"), decode=True)
    left = found.where("n_removed < n_bytes or n_bytes = 0")
    count = F.length("cleaned").cast(left.schema["carried"].dataType["n_chars"].dataType)
    return left.select("doc_id", F.col("cleaned").alias("text"), "carried.lang", "carried.source", F.when(F.col("n_removed") > 0, count).otherwise(F.col("carried.n_chars")).alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(docs, items, carry=("text", "lang", "source", "n_chars"))
    return found.where("n_hit = 0").select("doc_id", "carried.*").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", keep_one_of_linked),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Trained scores and tokens are beyond SQL; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each is written to the shared folder before the next reads it."""
    stage = shared.Stage(spark, "pipeline")
    docs = shared.documents(spark, sf_dir)
    for _, step in STAGES[:-1]:
        docs = stage.write(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
