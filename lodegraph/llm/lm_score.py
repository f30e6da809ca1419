"""Language-model scores by context-tree weighting.

Each byte is eight binary decisions.  For every decision and every depth of
preceding bytes a Krichevsky-Trofimov estimate is kept, and the estimates along
a context's path are mixed with the weights that context-tree weighting gives
them after the training texts.  A context that training never met has no say:
the mix ends at the deepest one that it met.

How it runs: texts are written once, in chunks of a few MB.  A chunk deals its
distinct byte grams and words to buckets, grams by their two nearest bytes of
context, three where two are very common, and so on up to six: what a context brings
to a bucket stays below a few MB of text, however large the table (up to 16 GB of
text, then a 4,096th of it).  A bucket then holds all deeper contexts of its own, so it
is weighted by itself, a few contexts at a time; the shallow depths, 2^16 nodes and
those above very common contexts (at most 4,096 a depth), meet on the driver.  A bucket answers each chunk with the code lengths of the grams
(the counts of the words) that it asked for, in their order, and a chunk sums
them up by text.  So no table of the model is held as a whole anywhere, the
texts are gone through twice whatever the size of the model, and the number of buckets
grows with the input.

Defined results: a null text is empty and has the end symbol alone; without
training rows each decision costs one bit and base counts are 0; a very long
text is alone in its chunk, which takes some 60 times its size of memory; repeated
rows count and are scored one by one; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, texts

DEPTH = 6
#: Begins and ends every text; no UTF-8 text has it.
EDGE = 0xFF
#: Text bytes of a chunk, about.
CHUNK_BYTES = 4 << 20
#: Text bytes for each bucket.
BUCKET_BYTES = 2 << 20
#: A context is dealt by one byte more if it has more than this share of all bytes,
#: or more than so many bytes and one in MOST_COMMON.
COMMON = 1 / 256
COMMON_BYTES = 4 << 20
MOST_COMMON = 4096
#: Contexts of three bytes and more are counted at one place in so many; only how
#: grams are dealt hangs on that.
STRIDE = 16
#: Grams weighted at a time, about.
PIECE = 250_000
#: Tasks of a shuffle at most, unless the session asks for more.
MOST_PARTS = 1 << 16
LOG2 = np.log(2.0)
GRAMS, WORDS = 0, 1


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for every byte and every end: the bytes before, latest first, then
    the byte; and where each row's begin."""
    rows = len(off) - 1
    size = np.diff(off)
    step = DEPTH + 1
    out = np.full(len(data) + rows * step, EDGE, np.uint8)
    body = np.ones(len(out), bool)  # all but the DEPTH bytes before each row
    gap = (off[:-1] + np.arange(rows) * step)[:, None] + np.arange(DEPTH)
    body[gap.ravel()] = False
    end = off[1:] + np.arange(1, rows + 1) * step - 1
    own = body.copy()
    own[end] = False
    out[own] = data
    key = out.astype(np.uint64)
    for k in range(1, step):
        before = out[:-k].astype(np.uint64)
        before <<= np.uint64(8 * (step - k))
        key[k:] |= before
        del before  # these arrays are a chunk's largest
    return key[body], np.concatenate([[0], np.cumsum(size + 1)])


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and where each row's begin."""
    low = texts.ASCII_LOWER[data]
    start, end = texts.runs(texts.IS_PLAIN_WORD[low], off)
    return texts.span_hash(texts.prefix_hash(texts.table(2)[low]), start, end), texts.per_row(start, off)


def _log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2) - log Gamma(1/2), by its table or Stirling's series."""
    small = _HALF[np.minimum(n, len(_HALF) - 1).astype(np.int64)]
    x = n + 0.5
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) - 0.5 * np.log(np.pi)
    return np.where(n < len(_HALF), small, series)


def _log_factorial(n: np.ndarray) -> np.ndarray:
    small = _WHOLE[np.minimum(n, len(_WHOLE) - 1).astype(np.int64)]
    x = n + 1.0
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < len(_WHOLE), small, series)


_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(4095) + 0.5))])
_WHOLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(4095) + 1.0))])


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives so many zeros and ones."""
    return _log_gamma_half(zeros) + _log_gamma_half(ones) - _log_factorial(zeros + ones)


class Nodes:
    """One depth's nodes: (context, decision), their counts and weights."""

    def __init__(self, keys, zeros, ones, below):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        estimate = log_kt(zeros, ones)
        self.log_weighted = estimate if below is None else np.logaddexp(estimate, below) - LOG2
        self.own = np.exp(estimate - LOG2 - self.log_weighted) if below is not None else np.ones(len(keys))

    def mixed(self, at, bit, deeper):
        """Probability of each decision's bit; NaN where training met no such node."""
        zeros, ones, own = self.zeros[at], self.ones[at], self.own[at]
        total = zeros + ones
        estimate = (np.where(bit, ones, zeros) + 0.5) / (total + 1)
        if deeper is not None:
            estimate = np.where(np.isnan(deeper), estimate, own * estimate + (1 - own) * deeper)
        return np.where(total > 0, estimate, np.nan)


def decisions(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, decision) of a gram's eight bits, and the bits."""
    symbol = keys & np.uint64(0xFF)
    j = np.arange(8, dtype=np.uint64)
    node = (np.uint64(1) << j)[None, :] | (symbol[:, None] >> (np.uint64(8) - j)[None, :])
    bit = ((symbol[:, None] >> (np.uint64(7) - j)[None, :]) & np.uint64(1)).astype(bool)
    return (keys >> np.uint64(8))[:, None] << np.uint64(8) | node, bit


def shorten(nodes: np.ndarray) -> np.ndarray:
    """The same decisions with one byte less of context."""
    return nodes >> np.uint64(16) << np.uint64(8) | nodes & np.uint64(0xFF)


def weigh(keys: np.ndarray, counts: np.ndarray, stop: int = 2):
    """Nodes of depths DEPTH to `stop`, each with its nodes' places one up."""
    node, bit = decisions(keys)
    unique, at = np.unique(node.ravel(), return_inverse=True)
    many = np.repeat(counts.astype(np.float64), 8)
    ones = np.bincount(at, weights=many * bit.ravel(), minlength=len(unique))
    zeros = np.bincount(at, weights=many, minlength=len(unique)) - ones
    levels = [Nodes(unique, zeros, ones, None)]
    ups = []
    for _ in range(DEPTH - stop):
        last = levels[-1]
        unique, up = np.unique(shorten(last.keys), return_inverse=True)
        gather = lambda x: np.bincount(up, weights=x, minlength=len(unique))  # noqa: E731, B023
        levels.append(Nodes(unique, gather(last.zeros), gather(last.ones), gather(last.log_weighted)))
        ups.append(up)
    return levels, ups, at, bit.ravel()


def _context(keys: np.ndarray, depth) -> np.ndarray:
    return keys >> np.asarray(8 * (DEPTH + 1 - depth)).astype(np.uint64)


def _own_depth(keys: np.ndarray, common: dict[int, np.ndarray]) -> np.ndarray:
    """By how many bytes of context each of the sorted grams is dealt."""
    change = np.zeros(len(keys) + 1, np.int64)
    for depth, hot in common.items():  # each within one of the depth before
        shift = np.uint64(8 * (DEPTH + 1 - depth))
        np.add.at(change, np.searchsorted(keys, hot << shift), 1)
        np.add.at(change, np.searchsorted(keys, (hot + np.uint64(1)) << shift), -1)
    return 2 + np.cumsum(change[:-1])


def _pieces(keys: np.ndarray, common: dict[int, np.ndarray]):
    """Places of sorted grams that are weighted together, no context that they are
    dealt by in two of them, and its depth."""
    own = _own_depth(keys, common)
    for depth in np.unique(own).tolist():
        at = np.flatnonzero(own == depth)
        context = _context(keys[at], depth)
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        wanted = np.searchsorted(first, np.arange(0, len(at), PIECE))
        edge = np.unique(np.append(np.append(first, len(at))[wanted], len(at)))
        for low, high in zip(edge[:-1].tolist(), edge[1:].tolist()):
            yield at[low:high], depth


class Top:
    """Depths 1 and 0, as arrays over all their possible nodes, and the nodes of
    the common contexts by depth."""

    def __init__(self, depth: np.ndarray, nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray, common: dict[int, np.ndarray]):
        self.common = common
        gather = lambda at, x, n: np.bincount(at, weights=x, minlength=n)
        none = np.zeros(0)
        last, self.levels = Nodes(none.astype(np.uint64), none, none, None), {}

        def met(d):
            """What buckets and the depth below add to the nodes of a depth."""
            mine = depth == d
            joined = (np.concatenate([x[mine], y]) for x, y in zip((zeros, ones, weighted), (last.zeros, last.ones, last.log_weighted)))
            return np.concatenate([nodes[mine].astype(np.uint64), shorten(last.keys)]), joined

        for d in range(DEPTH - 1, 1, -1):
            below, joined = met(d)
            keys, at = np.unique(below, return_inverse=True)
            last = self.levels[d] = Nodes(keys, *(gather(at, x, len(keys)) for x in joined))
        below, joined = met(1)
        self.one = Nodes(np.arange(1 << 16), *(gather(below.astype(np.int64), x, 1 << 16) for x in joined))
        at = np.arange(1 << 16) & 0xFF
        self.none = Nodes(np.arange(256), *(gather(at, x, 256) for x in (self.one.zeros, self.one.ones, self.one.log_weighted)))


def code_lengths(keys: np.ndarray, counts: np.ndarray, top: Top) -> np.ndarray:
    """log10 probability of each gram's last byte after the others."""
    out = np.zeros(len(keys))
    for mine, stop in _pieces(keys, top.common):
        levels, ups, at, bit = weigh(keys[mine], counts[mine], stop)
        p = levels[0].mixed(at, bit, None)
        for level, up in zip(levels[1:], ups):
            at = up[at]
            p = level.mixed(at, bit, p)
        above = shorten(levels[-1].keys)[at]
        for d in range(stop - 1, 1, -1):
            p = top.levels[d].mixed(np.searchsorted(top.levels[d].keys, above), bit, p)
            above = shorten(above)
        at = above.astype(np.int64)
        p = top.one.mixed(at, bit, p)
        p = top.none.mixed(at & 0xFF, bit, p)
        out[mine] = np.log10(np.where(np.isnan(p), 0.5, p)).reshape(-1, 8).sum(1)
    return out


_whole, _numbers = texts.planes, texts.numbers


def _rising(values: np.ndarray) -> bytes:
    return _whole(np.diff(values, prepend=values.dtype.type(0)))


def _places(blob) -> np.ndarray:
    return np.cumsum(_numbers(blob), dtype=np.uint64)


def _dealt(kind: int, keys: np.ndarray, buckets: int, common: dict[int, np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """The places of each bucket's keys."""
    spread = keys
    if kind == GRAMS:
        depth = _own_depth(keys, common)
        spread = texts.mix(_context(keys, depth) | depth.astype(np.uint64) << np.uint64(56))
    where = (spread >> np.uint64(33)).astype(np.int64) % buckets
    order = np.argsort(where, kind="stable")
    edge = np.searchsorted(where[order], np.arange(buckets + 1))
    return [(int(b), order[edge[b] : edge[b + 1]]) for b in np.flatnonzero(np.diff(edge))]


def _seen(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts, their depth above them, and how many bytes follow each: all of two
    bytes, of more those that more than a few follow, as a sample has them."""
    pair = data[1:].astype(np.int64) << 8 | data[:-1]
    seen = np.bincount(pair, minlength=1) if len(pair) else np.zeros(0, np.int64)
    at = np.flatnonzero(seen)
    contexts, counts = [at | 2 << 48], [seen[at]]
    place = np.arange(DEPTH - 2, len(data), STRIDE)
    context = data[place].astype(np.int64)
    for d in range(2, DEPTH):
        context = context << 8 | data[place - d + 1]
        if d > 2:
            found, n = np.unique(context, return_counts=True)
            many = n * STRIDE * 2 * MOST_COMMON > len(data)
            contexts.append(found[many] | d << 48)
            counts.append(n[many] * STRIDE)
    return np.concatenate(contexts), np.concatenate(counts)


def _common(rows: list) -> dict[int, np.ndarray]:
    """The contexts by depth, each within one of the depth before."""
    found = np.array(sorted(rows), np.int64)
    common = {}
    for d in range(2, DEPTH):
        mine = (found[found >> 48 == d] & ((1 << 48) - 1)).astype(np.uint64)
        common[d] = mine if d == 2 else mine[np.isin(mine >> np.uint64(8), common[d - 1])]
    return common


def _chunks(schema: T.StructType, limit: int):
    """Rows of one chunk of texts each, with the counts of its contexts."""

    def pack(held, number) -> pa.RecordBatch:
        from pyspark import TaskContext

        train = np.concatenate([h[1] for h in held])
        data = np.concatenate([h[2] for h in held])
        off = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(h[3]) for h in held]))])
        contexts, counts = _seen(data)
        ids = pa.concat_arrays([h[0] for h in held])
        columns = [
            pa.array([TaskContext.get().partitionId() << 32 | number]),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            *(pa.array([x.tobytes()], pa.binary()) for x in (train, data, off)),
            pa.array([int(train.sum())]),
            pa.array([len(data)]),
            *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64())) for x in (contexts, counts)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, number = [], 0, 0
        for batch in batches:
            for piece, data, off in texts.blocks(batch, "text", limit):
                held.append((piece.column(0), piece.column("train").to_numpy(zero_copy_only=False).astype(bool), data, off))
                total += len(data) + 16 * (len(off) - 1)
                if 4 * total >= 3 * limit:
                    yield pack(held, number)
                    held, total, number = [], 0, number + 1
        if held:
            yield pack(held, number)

    return run


def _keys(kind: int, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return grams(data, off) if kind == GRAMS else words(data, off)


def _unpacked(batch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    train, data, off = (np.frombuffer(texts.blobs(batch.column(c).slice(k, 1))[0], t) for c, t in (("train", bool), ("data", np.uint8), ("off", np.int64)))
    return train, data, off


def _ask(buckets: int, common: dict[int, np.ndarray]):
    """A chunk's distinct grams and words, with their counts in training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts.hold("counting")
        for batch in batches:
            for k in range(batch.num_rows):
                train, data, off = _unpacked(batch, k)
                for kind in (GRAMS, WORDS):
                    keys, first = _keys(kind, data, off)
                    learn = np.repeat(train, np.diff(first))
                    if kind == GRAMS:  # one sort, with training as the lowest bit
                        keys <<= np.uint64(1)
                        keys |= learn
                        keys.sort()
                        learn = keys.astype(np.uint8) & 1
                        keys >>= np.uint64(1)
                    else:
                        order = np.argsort(keys, kind="stable")
                        keys, learn = keys[order], learn[order]
                    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
                    if not len(start):
                        continue
                    counts, keys = np.add.reduceat(learn, start, dtype=np.int64), keys[start]
                    rows = _dealt(kind, keys, buckets, common)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([kind] * len(rows), pa.int32()),
                            pa.array([b for b, _ in rows], pa.int32()),
                            pa.array([batch.column("chunk")[k].as_py()] * len(rows), pa.int64()),
                            pa.array([_rising(keys[at]) for _, at in rows], pa.binary()),
                            pa.array([_whole(counts[at]) for _, at in rows], pa.binary()),
                        ],
                        names=["kind", "bucket", "chunk", "keys", "counts"],
                    )
                texts.release()

    return run


_ASKED = "kind int, bucket int, chunk long, keys binary, counts binary"
_GATHERED = "kind int, bucket int, keys binary, counts binary, chunks binary, sizes binary, places binary, seen long, total long"


def _gather(table: pa.Table) -> pa.Table:
    """A bucket's distinct keys with their counts, and which of them each chunk
    asks for."""
    texts.hold("gathering")
    parts = [_places(x) for x in texts.blobs(table.column("keys"))]
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    counts = np.bincount(at, weights=np.concatenate([_numbers(x) for x in texts.blobs(table.column("counts"))]), minlength=len(keys)).astype(np.uint64)
    sizes = np.array([len(x) for x in parts])
    first = np.cumsum(sizes) - sizes
    steps = np.diff(at, prepend=0)
    steps[first] = at[first]
    chunks = table.column("chunk").combine_chunks().to_numpy()
    blobs = [_rising(keys), _whole(counts), chunks.tobytes(), sizes.astype(np.int64).tobytes(), _whole(steps)]
    row = [table.column("kind")[0].as_py(), table.column("bucket")[0].as_py(), *blobs, int((counts > 0).sum()), int(counts.sum())]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.int64(), pa.int64()]
    return pa.table([pa.array([x], k) for x, k in zip(row, kinds)], names=["kind", "bucket", "keys", "counts", "chunks", "sizes", "places", "seen", "total"])


def _tops(common: dict[int, np.ndarray]):
    """What a bucket adds to the shallow nodes above its contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(texts.blobs(batch.column("keys")), texts.blobs(batch.column("counts"))):
                keys, counts = _places(k), _numbers(c)
                for mine, stop in _pieces(keys, common):
                    last = weigh(keys[mine], counts[mine], stop)[0][-1]
                    nodes, up = np.unique(shorten(last.keys), return_inverse=True)
                    sums = [np.bincount(up, weights=x, minlength=len(nodes)) for x in (last.zeros, last.ones, last.log_weighted)]
                    yield pa.RecordBatch.from_arrays([pa.array([stop - 1] * len(nodes), pa.int32()), pa.array(nodes.astype(np.int64)), *map(pa.array, sums)], names=["depth", "node", "zeros", "ones", "weighted"])
                texts.release()

    return run


def _answer(top):
    """To each chunk what it asked of the bucket: code lengths, or counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts.hold("answering")
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                kind, bucket = row["kind"].as_py(), row["bucket"].as_py()
                blob = lambda c: row[c].as_buffer()  # noqa: E731, B023
                counts = _numbers(blob("counts"))
                value = code_lengths(_places(blob("keys")), counts, top.value).astype(np.float32) if kind == GRAMS else counts
                chunks, sizes, steps = np.frombuffer(blob("chunks"), np.int64), np.frombuffer(blob("sizes"), np.int64), _numbers(blob("places")).astype(np.int64)
                edge = np.concatenate([[0], np.cumsum(sizes)])
                got = [value[np.cumsum(steps[a:b])] for a, b in zip(edge[:-1], edge[1:])]
                packed = [x.tobytes() if kind == GRAMS else _whole(x) for x in got]
                n = len(chunks)
                yield pa.RecordBatch.from_arrays([pa.array(chunks), pa.array([kind] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "kind", "bucket", "value"])
                texts.release()

    return run


def score(docs: DataFrame, held_out: int | None = 1, modulus: int = 5, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, common_share: float = COMMON) -> DataFrame:
    """One row per document: doc_id, held_out, n_bytes, n_tokens, n_known,
    train_tokens, base_score, score.

    Learns from the rows whose crc32(id) mod `modulus` is not `held_out`.
    """
    spark = docs.sparkSession
    stage = shared.Stage(spark, "lm")
    train = F.lit(True) if held_out is None else shared.remainder("doc_id", modulus) != held_out
    frame = shared.pick(docs, doc_id=doc_id, text=text).withColumn("train", train)
    id_type = frame.schema["doc_id"].dataType
    longs = lambda *names: [T.StructField(k, T.LongType()) for k in names]
    blobs = [T.StructField(k, T.BinaryType()) for k in ("train", "data", "off")]
    chunked = T.StructType([*longs("chunk"), T.StructField("doc_ids", T.ArrayType(id_type)), *blobs, *longs("ends", "bytes"), T.StructField("contexts", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))])
    # Spark reads a file's rows by the thousand, and these are of some MB each
    chunks = stage.write(frame.mapInArrow(_chunks(chunked, chunk_bytes), chunked), rows=2)
    ends, size = (int(x or 0) for x in chunks.agg(F.sum("ends"), F.sum("bytes")).first())
    contexts = chunks.select(F.explode(F.arrays_zip("contexts", "counts")).alias("p")).groupBy("p.contexts").agg(F.sum("p.counts").alias("n"))
    much = min(size * common_share, max(COMMON_BYTES, size / MOST_COMMON))
    common = _common([r[0] for r in contexts.where(F.col("n") > much).select("contexts").collect()])
    buckets = max(shared.partitions(spark), min(1 << 20, size // bucket_bytes))
    parts = min(buckets, max(shared.partitions(spark), MOST_PARTS))  # tasks, too, grow in number with the input
    texts_ = chunks.select("chunk", "doc_ids", "train", "data", "off")
    asked = texts_.drop("doc_ids").mapInArrow(_ask(buckets, common), _ASKED)
    gathered = stage.write(asked.repartition(parts, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(_gather, _GATHERED))
    seen, total = (int(x or 0) for x in gathered.where(F.col("kind") == WORDS).agg(F.sum("seen"), F.sum("total")).first())
    tops = gathered.where(F.col("kind") == GRAMS).select("keys", "counts").mapInArrow(_tops(common), "depth int, node long, zeros double, ones double, weighted double")
    tops = tops.groupBy("depth", "node").agg(*(F.sum(k).alias(k) for k in ("zeros", "ones", "weighted"))).toPandas()
    top = shared.ship(spark, Top(*(tops[k].to_numpy() for k in ("depth", "node", "zeros", "ones", "weighted")), common))
    answers = gathered.drop("seen", "total").mapInArrow(_answer(top), "chunk long, kind int, bucket int, value binary")
    facts = {"tokens": total + ends, "vocabulary": seen + (ends > 0), "ends": ends}
    scored = T.StructType([T.StructField("doc_id", id_type), T.StructField("held_out", T.BooleanType()), *longs("n_bytes", "n_tokens", "n_known", "train_tokens"), *(T.StructField(k, T.DoubleType()) for k in ("base_score", "score"))])
    dealt = [frame.repartition(parts, "chunk").groupBy("chunk") for frame in (texts_, answers)]
    return dealt[0].cogroup(dealt[1]).applyInArrow(_sums(facts, buckets, common, scored.names), scored)


def _sums(facts: dict, buckets: int, common: dict[int, np.ndarray], names: list[str]):
    """A chunk's texts with the sums over its answers."""
    tokens, kinds, ends = facts["tokens"], facts["vocabulary"], facts["ends"]
    cost = lambda c: np.log10((c + 0.5) / (tokens + 0.5 * (kinds + 1)))

    def values(kind: int, keys: np.ndarray, answers: dict) -> np.ndarray:
        order = np.argsort(keys)
        ranked = keys[order]
        opens = np.append(True, ranked[1:] != ranked[:-1]) if len(keys) else np.zeros(0, bool)
        known = ranked[opens]
        del ranked
        at = np.empty(len(keys), np.int32)
        at[order] = np.cumsum(opens, dtype=np.int32) - 1
        del order, opens
        value = np.zeros(len(known), np.float32 if kind == GRAMS else np.int64)
        for bucket, places in _dealt(kind, known, buckets, common):
            blob = answers[kind, bucket]
            value[places] = np.frombuffer(blob, np.float32) if kind == GRAMS else _numbers(blob)
        return value[at]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts.hold("scoring")
        train, data, off = _unpacked(left, 0)
        answers = {(k, b): v for k, b, v in zip(right.column("kind").to_pylist(), right.column("bucket").to_pylist(), texts.blobs(right.column("value")))}
        rows = len(off) - 1
        got, first = grams(data, off)
        got = values(GRAMS, got, answers)
        total = np.add.reduceat(got, first[:-1], dtype=np.float64)
        del got
        h, begin = words(data, off)
        count = values(WORDS, h, answers)
        row = np.repeat(np.arange(rows), np.diff(begin))
        base = np.bincount(row, weights=cost(count), minlength=rows) + cost(ends)
        known = np.bincount(row, weights=count > 0, minlength=rows).astype(np.int64) + (ends > 0)
        ids = left.column("doc_ids").combine_chunks().flatten()
        texts.release()
        return pa.table([ids, pa.array(~train), pa.array(np.diff(off)), pa.array(np.diff(begin) + 1), pa.array(known), pa.array(np.full(rows, tokens)), pa.array(base), pa.array(total)], names=names)

    return run


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(shared.documents(spark, sf_dir))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", (-F.col("score") / F.log10(F.lit(2.0)) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"))
