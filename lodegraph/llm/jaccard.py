"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct word shingles.  Documents of equal sets are
one class.  Shingles are ordered rarest first; of a set of n whose partners must
share at least a = ceil(t n) shingles, the first n - a + l are its l-prefix, and
two linked sets share at least l of them for every l.  Each class lengthens its
prefix, choosing the l of the least estimated cost: reading the inverted lists,
plus verifying the candidates that still match l times.

How it runs: one pass gives each document's class, another deals all shingles to
buckets as sorted arrays; a bucket keeps those that two classes share, with
their frequencies, and deals them back by class.  A class with fewer than a
shared shingles has no link and is done.  The rest, mostly near copies, are
gathered by the prefix shingles that they share, directly or in a chain; each
cluster is joined in one task, large ones in blocks, pair of blocks by pair of
blocks.  Only the links that first connect two parts leave a task.

Shingles are compared by 64-bit hashes throughout.  Only links that first connect
two parts are looked for, so what is known are the components, not the number of
links.

Defined results: a text of any length is one set, made in one task in some 100
times its size of memory; documents without words or with null text have an empty set
and are linked with nothing, each its own component; rows of a null id take part
and the smallest non-null id names the component (their own is null if there is
none); repeated rows are in one class; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, texts
from .components import components

SHINGLE = 4
PERCENT = 85
MOST_MATCHES = 8
#: Classes that one task joins; a larger cluster is joined in pairs of blocks.
CLUSTER = 4096
BLOCK = 2048
#: Shingles a task holds before it deals them out.
HELD_SHINGLES = 1_000_000


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all rows, row by row sorted, and where each row's begin."""
    low = texts.ASCII_LOWER[data]
    start, end = texts.runs(texts.IS_PLAIN_WORD[low], off)
    first = texts.per_row(start, off)
    word = texts.span_hash(texts.prefix_hash(texts.table(3)[low]), start, end)
    running = texts.prefix_hash(word)
    count = np.diff(first)
    row, place = texts.ragged(np.where(count > 0, np.maximum(1, count - size + 1), 0))
    begin = first[row] + place
    h = texts.span_hash(running, begin, np.minimum(begin + size, first[row + 1]))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(len(off)))


def identities(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit value for each set, from two sums over its shingles; 0 if empty."""
    total = np.zeros((2, len(h) + 1), np.uint64)
    np.cumsum(texts.mix(h ^ np.uint64(0xA5A5)), out=total[0, 1:])
    np.cumsum(texts.mix(h + np.uint64(0x1234567)), out=total[1, 1:])
    a, b = (t[first[1:]] - t[first[:-1]] for t in total)
    n = np.diff(first).astype(np.uint64)
    value = texts.mix(a ^ texts.mix(b + n)) | np.uint64(1)
    return np.where(n > 0, value, np.uint64(0)).view(np.int64)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that any partner of a set of n shares with it."""
    return (percent * n + 99) // 100


def _classes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, off in texts.blocks(batch, "text"):
                h, first = shingle_sets(data, off, size)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(first)), pa.array(identities(h, first))], names=["doc_id", "n", "class"])

    return run


def _halves(tokens: np.ndarray) -> tuple[bytes, bytes]:
    """The low and the high halves of the hashes, apart."""
    return tokens.astype(np.uint32).tobytes(), (tokens >> np.uint64(32)).astype(np.uint32).tobytes()


def _tokens(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, np.uint32).astype(np.uint64) | np.frombuffer(high, np.uint32).astype(np.uint64) << np.uint64(32)


_DEALT = "bucket int, low binary, high binary, own binary, classes binary, sizes binary"


def _deal(buckets: int, size: int):
    """Shingles of a task's distinct classes, a row of arrays for each bucket."""

    def hand_on(held):
        h = np.concatenate([x[0] for x in held])
        n = np.concatenate([x[1] for x in held])
        name = np.concatenate([x[2] for x in held])
        owner = np.repeat(np.arange(len(n)), n)
        where = (h >> np.uint64(48)).astype(np.int64) % buckets
        order = np.lexsort((h, where))
        edge = np.searchsorted(where[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edge)):
            part = order[edge[b] : edge[b + 1]]
            mine, own = np.unique(owner[part], return_inverse=True)
            low, high = _halves(h[part])
            own = own.astype(np.uint16 if len(mine) <= 65536 else np.uint32)
            row = [b], [low], [high], [own.tobytes()], [name[mine].tobytes()], [n[mine].astype(np.uint32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *(pa.array(x, pa.binary()) for x in row[1:])], names=["bucket", "low", "high", "own", "classes", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts.hold("jaccard")
        seen: set[int] = set()  # copies within the task are dealt once
        held, count = [], 0
        for batch in batches:
            for _, data, off in texts.blocks(batch, "text"):
                h, first = shingle_sets(data, off, size)
                name = identities(h, first)
                fresh = np.zeros(len(name), bool)
                for k, value in enumerate(name.tolist()):
                    if value and value not in seen:
                        seen.add(value)
                        fresh[k] = True
                n = np.diff(first)
                held.append((h[np.repeat(fresh, n)], n[fresh], name[fresh]))
                count += len(held[-1][0])
                if count > HELD_SHINGLES:
                    yield from hand_on(held)
                    held, count = [], 0
        if count:
            yield from hand_on(held)

    return run


_SHARED = "home int, classes binary, sizes binary, counts binary, low binary, high binary, often binary"


def _share(homes: int):
    """Of a bucket's shingles those of two classes or more, dealt back by class."""

    def run(table: pa.Table) -> pa.Table:
        texts.hold("jaccard")
        parts = []
        for r in table.to_batches():
            for low, high, own, classes, size in zip(*(texts.blobs(r.column(k)) for k in ("low", "high", "own", "classes", "sizes"))):
                name = np.frombuffer(classes, np.int64)
                at = np.frombuffer(own, np.uint16 if len(name) <= 65536 else np.uint32)
                parts.append((low, high, name, at, np.frombuffer(size, np.uint32)))
        # most shingles are a class's own: they go before owners are looked up
        token = np.concatenate([_tokens(low, high) for low, high, *_ in parts])
        order = np.argsort(token, kind="stable")
        ranked = token[order]
        twin = np.zeros(len(ranked), bool)
        twin[1:] = ranked[1:] == ranked[:-1]
        twin[:-1] |= twin[1:]
        del ranked
        mine = np.zeros(len(token), bool)
        mine[order[twin]] = True
        del order, twin
        token, owners, sizes, low = token[mine], [], [], 0
        for *_, name, at, size in parts:
            own = at[mine[low : low + len(at)]]
            owners.append(name[own])
            sizes.append(size[own])
            low += len(at)
        owner, size = np.concatenate(owners), np.concatenate(sizes)
        del owners, sizes, parts, mine
        order = np.lexsort((owner, token))
        token, owner, size = token[order], owner[order], size[order]
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, owner, size = token[keep], owner[keep], size[keep]
        opens = np.ones(len(token), bool)
        opens[1:] = token[1:] != token[:-1]
        often = np.diff(np.append(np.flatnonzero(opens), len(token)))
        often = np.repeat(often, often)
        keep = often > 1
        token, owner, size, often = token[keep], owner[keep], size[keep], np.minimum(often[keep], 65535)
        home = (owner.view(np.uint64) >> np.uint64(20)).astype(np.int64) % homes
        order = np.lexsort((owner, home))
        token, owner, size, often, home = (x[order] for x in (token, owner, size, often, home))
        edge = np.searchsorted(home, np.arange(homes + 1))
        rows = []
        for k in np.flatnonzero(np.diff(edge)):
            a, b = edge[k], edge[k + 1]
            name, first, count = np.unique(owner[a:b], return_index=True, return_counts=True)
            rows.append((int(k), name.tobytes(), size[a:b][first].tobytes(), count.astype(np.uint32).tobytes(), *_halves(token[a:b]), often[a:b].astype(np.uint16).tobytes()))
        columns = list(zip(*rows)) if rows else [()] * 7
        return pa.table([pa.array(columns[0], pa.int32()), *(pa.array(x, pa.binary()) for x in columns[1:])], names=["home", "classes", "sizes", "counts", "low", "high", "often"])

    return run


_PREFIXED = "class long, n long, matches int, prefix int, tokens binary"


def choose(often: np.ndarray, spare: int, n: int, most: int) -> int:
    """How many matches to ask for: the l of the least estimated cost.

    Reading costs the lists' lengths; of the places read, at most one in l can
    be a candidate, which costs a verification of n / 8 reads.
    """
    reading = np.cumsum(often.astype(np.float64))
    best, least = 1, np.inf
    for matches in range(1, most + 1):
        length = min(len(often), spare + matches)
        read = reading[length - 1]
        cost = read + (read - length) / matches**2 * n / 8
        if cost < least:
            best, least = matches, cost
    return best


def _prefixes(percent: int, most: int):
    """Classes that share enough shingles, with their chosen prefix."""

    def run(table: pa.Table) -> pa.Table:
        owners, tokens, oftens, sizes = [], [], [], {}
        for r in table.to_batches():
            for classes, size, counts, low, high, often in zip(*(texts.blobs(r.column(k)) for k in ("classes", "sizes", "counts", "low", "high", "often"))):
                name = np.frombuffer(classes, np.int64)
                owners.append(np.repeat(name, np.frombuffer(counts, np.uint32)))
                tokens.append(_tokens(low, high))
                oftens.append(np.frombuffer(often, np.uint16))
                sizes.update(zip(name.tolist(), np.frombuffer(size, np.uint32).tolist()))
        owner, token, often = np.concatenate(owners), np.concatenate(tokens), np.concatenate(oftens)
        name, back, count = np.unique(owner, return_inverse=True, return_counts=True)
        n = np.array([sizes[k] for k in name.tolist()], np.int64)
        least = needed(n, percent)
        alive = count >= least
        keep = alive[back]
        token, often, back = token[keep], often[keep], back[keep]
        order = np.lexsort((token, often, back))
        token, often, back = token[order], often[order], back[order]
        rows = []
        for k in np.flatnonzero(alive):
            a, b = np.searchsorted(back, k), np.searchsorted(back, k, "right")
            spare = int(count[k] - least[k])
            matches = choose(often[a:b], spare, int(n[k]), min(most, int(least[k])))
            rows.append((int(name[k]), int(n[k]), matches, min(b - a, spare + matches), token[a:b].tobytes()))
        columns = list(zip(*rows)) if rows else [()] * 5
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.binary())], names=["class", "n", "matches", "prefix", "tokens"])

    return run


def _prefix_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        name, prefix = batch.column("class").to_pylist(), batch.column("prefix").to_pylist()
        got = [np.frombuffer(t, np.int64)[:p] for t, p in zip(texts.blobs(batch.column("tokens")), prefix)]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got)), pa.array(np.repeat(np.array(name, np.int64), prefix))], names=["token", "class"])


def join_links(n: np.ndarray, matches: np.ndarray, prefix: np.ndarray, tokens: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect parts, of the sets held in memory.

    A set looks at sets before it in order of size, and counts its matches in
    their prefixes; those with enough matches, of fitting size and of another
    part so far, are verified together.  With `side`, only pairs across sides.
    """
    if not len(n):
        return []
    order = np.argsort(n, kind="stable")
    count = np.array([len(tokens[k]) for k in order])
    known, code = np.unique(np.concatenate([tokens[k] for k in order]), return_inverse=True)
    edge = np.concatenate([[0], np.cumsum(count)])
    n, matches, prefix = n[order], matches[order], prefix[order]
    side = None if side is None else side[order]
    # inverted lists of the prefixes, sets in order
    owner, place = texts.ragged(prefix)
    listed = code[edge[owner] + place]
    by = np.argsort(listed, kind="stable")
    starts = np.searchsorted(listed[by], np.arange(len(known) + 1))
    owner = owner[by]
    part = np.arange(len(n))
    marked = np.zeros(len(known), bool)
    links = []
    for x in range(len(n)):
        mine = code[edge[x] : edge[x] + prefix[x]]
        low, high = starts[mine], starts[mine + 1]
        group, inner = texts.ragged(high - low)
        met = owner[low[group] + inner]
        met = met[met < x]
        if not len(met):
            continue
        hits = np.bincount(met, minlength=x)[:x]
        near = np.flatnonzero(hits)
        near = near[(hits[near] >= np.minimum(matches[near], matches[x])) & (100 * n[near] >= percent * n[x]) & (part[near] != part[x])]
        if side is not None:
            near = near[side[near] != side[x]]
        if not len(near):
            continue
        all_mine = code[edge[x] : edge[x + 1]]
        marked[all_mine] = True
        group, inner = texts.ragged(count[near])
        common = np.bincount(group, weights=marked[code[edge[near][group] + inner]], minlength=len(near)).astype(np.int64)
        marked[all_mine] = False
        for y in near[100 * common >= percent * (n[near] + n[x] - common)]:
            if part[y] != part[x]:
                links.append((int(order[x]), int(order[y])))
                part[part == part[y]] = part[x]
    return links


def _join(percent: int):
    def run(table: pa.Table) -> pa.Table:
        get = lambda k: table.column(k).combine_chunks().to_numpy(zero_copy_only=False)
        name = get("class")
        side = get("side")
        links = join_links(get("n"), get("matches").astype(np.int64), get("prefix").astype(np.int64), [np.frombuffer(t, np.uint64) for t in texts.blobs(table.column("tokens"))], percent, side if side.max() > 0 else None)
        return pa.table([pa.array([int(name[x]) for x, _ in links], pa.int64()), pa.array([int(name[y]) for _, y in links], pa.int64())], names=["a", "b"])

    return run


def _tasks(survivors: DataFrame, label: DataFrame, buckets: int) -> DataFrame:
    """Survivors dealt to joining tasks: whole clusters, or pairs of blocks."""
    sizes = label.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    placed = survivors.join(label.join(sizes, "label"), survivors["class"] == label["node"]).drop("node")
    small = placed.where(F.col("members") <= CLUSTER).select("class", "n", "matches", "prefix", "tokens", F.concat(F.lit("c"), F.pmod(F.xxhash64("label"), F.lit(buckets)).cast("string")).alias("task"), F.lit(0).alias("side"))
    # blocks by a hash: of b blocks, each meets itself and the others
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    large = placed.where(F.col("members") > CLUSTER).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.concat_ws(":", F.col("label").cast("string"), F.least("block", "other").cast("string"), F.greatest("block", "other").cast("string"))
    across = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    large = large.select("class", "n", "matches", "prefix", "tokens", pair.alias("task"), across.alias("side"))
    return small.unionByName(large)


def link_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, most: int = MOST_MATCHES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class.

    `class` is equal for equal sets.  Documents link when the Jaccard
    similarity of their sets is at least `percent` / 100.
    """
    spark = docs.sparkSession
    stage = shared.Stage(spark, "jaccard")
    buckets = max(1, min(65536, shared.partitions(spark)))
    frame = shared.pick(docs, doc_id=doc_id, text=text)
    schema = f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, n long, class long"
    rows = stage.write(frame.mapInArrow(_classes(size), schema))
    dealt = frame.select("text").mapInArrow(_deal(buckets, size), _DEALT)
    common = dealt.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(_share(buckets), _SHARED)
    survivors = stage.write(common.groupBy("home").applyInArrow(_prefixes(percent, most), _PREFIXED))
    met = stage.write(survivors.mapInArrow(_prefix_tokens, "token long, class long"))
    hubs = met.groupBy("token").agg(F.min("class").alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1")
    label = components(met.join(hubs, "token").select(F.col("class").alias("a"), F.col("hub").alias("b")), stage)
    links = stage.write(_tasks(survivors, label, buckets).groupBy("task").applyInArrow(_join(percent), "a long, b long"))
    part = components(links, stage)
    least = rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("first"))
    named = least.join(part, least["class"] == part["node"]).groupBy("label").agg(F.min("first").alias("component"))
    linked = part.join(named, "label").select(F.col("node").alias("class"), "component")
    # a class of very many copies is a hot key; of two written tables joined as
    # they are, adaptive execution splits it
    final = stage.write(least.join(linked, "class", "left").select("class", F.coalesce("component", "first").alias("component_id")))
    for done in (survivors, met, links):  # a later stage needs their disk
        stage.drop(done)
    single = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "class")
    joined = rows.where("n > 0").join(final, "class").select("doc_id", "n", "component_id", "class")
    return joined.unionByName(single).withColumnRenamed("n", "n_shingles")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(shared.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * i >= 85 * (p.n + q.n - i)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON d.doc_id = m.x
"""
