"""A bounded, repeatable sample of labelled texts to fit a classifier on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


#: A text of more than this share of the byte bound is passed over.
LARGEST = 1 / 8


def picked(docs: DataFrame, labels: DataFrame, value: str, held_out: int | None, modulus: int, limit: int, limit_bytes: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame | None:
    """place, text, label of at most `limit` rows and `limit_bytes` of text.

    Rows whose crc32(id) mod `modulus` is `held_out` are left aside.  Labelled
    documents come in the order of a hash of their id, so the same tables give
    the same sample; null labels and texts are passed over, as are texts above
    LARGEST of the bytes (unless there is no other), labels without a document
    take no place, and an id counts once, with its smallest label and text.
    Sizes are picked first, so only the sampled texts leave the executors.
    """
    spark = docs.sparkSession
    span = 1 << 40
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(span))
    wanted = shared.pick(labels, doc_id=doc_id, label=value).where("label is not null and doc_id is not null")
    if held_out is not None:
        wanted = wanted.where(shared.remainder("doc_id", modulus) != held_out)
    total = wanted.count()
    if not total:
        return None
    texts = shared.pick(docs, doc_id=doc_id, text=text).where("text is not null").withColumn("place", place)
    reach = min(1.0, 4 * limit / total)
    while True:  # farther, in the rare case that many labels have no document
        most = int(span * reach)
        near = wanted.where(place < most).groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
        near = F.broadcast(near) if total * reach <= 64 * limit else near
        sizes = texts.where(F.col("place") < most).select("doc_id", "place", F.octet_length("text").alias("n")).join(near, "doc_id")
        sizes = sizes.groupBy("place").agg(F.max("n").alias("n"), F.min("label").alias("label")).orderBy("place").limit(2 * limit).collect()
        if len(sizes) >= limit or reach == 1.0:
            break
        reach = min(1.0, reach * 8)
    chosen, held = [], 0
    for r in [r for r in sizes if r["n"] <= limit_bytes * LARGEST] or sizes[:1]:
        held += r["n"]
        if len(chosen) == limit or (chosen and held > limit_bytes):
            break
        chosen.append((r["place"], r["label"]))
    if not chosen:
        return None
    places = spark.createDataFrame(chosen, "place long, label int")  # at most `limit`
    return texts.join(F.broadcast(places), "place").groupBy("place").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def ordered(rows: pd.DataFrame) -> list[tuple[str, int]]:
    """(text, label) of `picked` rows in the order of place, an id once."""
    rows = rows.sort_values(["place", "text"], kind="stable").drop_duplicates("place")
    return list(zip(rows["text"].tolist(), rows["label"].tolist()))


def labelled(*args, **named) -> list[tuple[str, int]]:
    """(text, label) of the rows that `picked` gives, on the driver."""
    rows = picked(*args, **named)
    return [] if rows is None else ordered(rows.toPandas())
