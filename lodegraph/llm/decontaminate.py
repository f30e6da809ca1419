"""Benchmark decontamination with one Aho-Corasick automaton.

The items' windows of consecutive words are the patterns; each text is
normalised to its words, scanned once, and the matches are mapped back to the
words and to the offsets of the original text.

Defined results: a null or wordless text has no words and no hits; an item
without words, or with a null id, matches nothing; a text of any length is
scanned whole, alone in its block; repeated items count once;
repeated documents give one row each; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, texts

WINDOW = 10
#: Bytes of item texts in one automaton, whose nodes take some 600 bytes for each
#: of them; larger sets take several automata and as many scans of a text.
AUTOMATON_BYTES = 512 << 10

#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z is lower-cased.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = True
IS_WORD[97:123] = True
IS_WORD[128:] = True


def normalised(data: np.ndarray, off: np.ndarray):
    """Words of all rows, each followed by a space, rows begun by one more.

    Returns the buffer, the words' starts and ends in `data`, and the first
    word of each row.
    """
    low = texts.ASCII_LOWER[data]
    mask = IS_WORD[low]
    starts, ends = texts.runs(mask, off)
    first = texts.per_row(starts, off)
    length = ends - starts
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    out = np.full(int(length.sum()) + len(starts) + len(off) - 1, 32, np.uint8)
    word, place = texts.ragged(length)
    begin = np.cumsum(length) - length + np.arange(len(starts)) + row + 1
    out[begin[word] + place] = low[starts[word] + place]
    return out, starts, ends, first


def windows(text: str | None, n: int = WINDOW) -> list[tuple[str, int]]:
    """An item's patterns with their lengths in words."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    out, starts, _, _ = normalised(raw, np.array([0, len(raw)]))
    words = out.tobytes().decode().split()
    if not words:
        return []
    n = min(n, len(words))
    return [(f" {' '.join(words[i : i + n])} ", n) for i in range(len(words) - n + 1)]


def _automaton(items: list[tuple[int, str]], n: int):
    import ahocorasick

    held = texts.hold("automata", dict)
    key = hashlib.sha256(repr((n, items)).encode()).hexdigest()
    if key not in held:
        patterns: dict[str, tuple[int, set]] = {}
        for item, text in items:
            for pattern, words in windows(text, n):
                patterns.setdefault(pattern, (words, set()))[1].add(item)
        built = ahocorasick.Automaton()
        for pattern, (words, where) in patterns.items():
            built.add_word(pattern, (words, tuple(sorted(where))))
        if patterns:
            built.make_automaton()
        held[key] = built, bool(patterns)
    return held[key]


def scan(data: np.ndarray, off: np.ndarray, items: list[tuple[int, str]], n: int = WINDOW):
    """For each row: its words, whether each is hit, and the items found."""
    automaton, any_pattern = _automaton(items, n)
    out, starts, ends, first = normalised(data, off)
    change = np.zeros(len(starts) + 1, np.int64)
    found: list[set] = [set() for _ in range(len(off) - 1)]
    if any_pattern and len(starts):
        hits = list(automaton.iter(out.tobytes().decode()))
        if hits:
            at = np.array([h[0] for h in hits])
            lead = np.flatnonzero((out & 0xC0) != 0x80)
            at = lead[at]  # the byte of the space that ends each match
            ended = np.zeros(len(out), bool)  # spaces that end a word
            ended[1:] = (out[1:] == 32) & (out[:-1] != 32)
            last = (np.cumsum(ended) - 1)[at]
            size = np.array([h[1][0] for h in hits])
            np.add.at(change, last - size + 1, 1)
            np.add.at(change, last + 1, -1)
            rows = np.searchsorted(first, last, "right") - 1
            for row, (_, (_, where)) in zip(rows.tolist(), hits):
                found[row].update(where)
    hit = np.cumsum(change)[:-1] > 0
    return starts, ends, first, hit, found


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, carried, n_words, n_hit, items, spans.

    ``carried`` is a struct of the columns named by `carry`.
    ``items`` lists the ids of the items with a window in the text; ``spans``
    the (start, end) of each run of hit words, in code points of the original.
    The document table is read once and never shuffled.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    carried = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    frame = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), carried.alias("carried"), F.col(f"`{text}`").alias("text"))
    parts = [[(r[0], r[1]) for r in part] for part in _shards(items, item_id, item_text)]
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([frame.schema["doc_id"], frame.schema["carried"], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(items.schema[item_id].dataType)), T.StructField("spans", span)])
    return frame.mapInArrow(_scanner([shared.ship(spark, p) for p in parts], window, _arrow(schema)), schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _shards(items: DataFrame, item_id: str, item_text: str) -> list[list]:
    """The items in sets of at most AUTOMATON_BYTES, with the sizes summed first."""
    rows = shared.pick(items, item=item_id, text=item_text).where("item is not null and text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    count = 1 + int(total // AUTOMATON_BYTES)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(count))).distinct()
    return [sorted(dealt.where(F.col("shard") == k).select("item", "text").collect(), key=lambda r: (str(r[0]), r[1])) for k in range(count)]


def _scanner(parts, window, schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, off in texts.blocks(batch, "text"):
                hit, found = None, [set() for _ in range(len(off) - 1)]
                for part in parts:
                    starts, ends, first, h, f = scan(data, off, part.value, window)
                    hit = h if hit is None else hit | h
                    found = [a | b for a, b in zip(found, f)]
                counted = np.zeros(len(hit) + 1, np.int64)
                np.cumsum(hit, out=counted[1:])
                n_hit = counted[first[1:]] - counted[first[:-1]]
                spans = [[] for _ in found]
                if hit.any():
                    points = np.zeros(len(data) + 1, np.int64)
                    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
                    for a, b in zip(*texts.runs(hit, first)):
                        row = int(np.searchsorted(first, a, "right")) - 1
                        base = points[off[row]]
                        spans[row].append({"start": int(points[starts[a]] - base), "end": int(points[ends[b - 1]] - base)})
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in found], schema.field("items").type), pa.array(spans, schema.field("spans").type)],
                    schema=schema,
                )

    return run


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(shared.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    listed = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS pat
      FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM i WHERE len(w) > 0)),
s AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS pat
      FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
m AS (SELECT s.doc_id, s.k, s.n, p.item_id FROM s JOIN p ON s.pat = p.pat AND s.n = p.n),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
