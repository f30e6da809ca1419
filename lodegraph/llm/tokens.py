"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens with array operations; distinct pre-tokens are
held as ragged arrays of symbols, and in each round every sequence applies its
own lowest-ranked pair at all its places at once, and any other pair that is
certain to come before what touches it, until none has a pair left.
Counts of distinct pre-tokens are kept in a sorted hash array of bounded size.

Defined results: a null text is empty and has no tokens; a text of any length,
also one unbroken word of many MB, is counted whole, in memory some 100 times
its size; repeated rows count alone; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, texts

VOCABULARY = "byte_bpe_50k.json"
#: Distinct pre-tokens a worker keeps; beyond it the store starts anew.
STORE_ENTRIES = 800_000
#: Symbols merged together at a time.
MERGE_SYMBOLS = 4_000_000

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
NONE = np.iinfo(np.int64).max


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def classes() -> np.ndarray:
    """Class of every code point, as the library's own expressions see it."""
    from tokenizers import Regex, normalizers

    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        for low in range(0, len(points), 65536):
            part = points[low : low + 65536]
            text = part.tobytes().decode("utf-32-le")
            # to a private-use character: one for one, so places are kept
            seen = np.frombuffer(normalizers.Replace(Regex(pattern), "\U00100000").normalize_str(text).encode("utf-32-le"), "<u4")
            out[part[seen != part]] = kind
    return out


@cache
def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _sorted_set(*parts: np.ndarray) -> np.ndarray:
    out = np.sort(np.concatenate(parts), kind="stable")
    return out[np.append(True, out[1:] != out[:-1])] if len(out) else out


class Guards:
    """For a symbol and the byte next to it, the least rank of a merge with any
    symbol that begins (or ends) with that byte."""

    def __init__(self, key: np.ndarray, rank: np.ndarray):
        order = np.lexsort((rank, key))
        key, rank = key[order], rank[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.key, self.rank = key[first], rank[first]

    def __call__(self, symbol: np.ndarray, byte: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.full(len(symbol), NONE)
        want = symbol << 8 | byte
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.rank[at], NONE)


class Merges:
    """A byte-level vocabulary's merges as sorted arrays of pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.special = [(t["content"].encode(), t["id"]) for t in spec["added_tokens"] if t["special"]]
        self.first = np.zeros(256, np.int64)
        for symbol, byte in _byte_symbols().items():
            self.first[byte] = ids[symbol]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.into = np.array([ids[a + b] for a, b in pairs], np.int64)
        key = left << 20 | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order
        # the bytes that a symbol begins and ends with
        self.head, self.tail = (np.zeros(max(ids.values()) + 1, np.int64) for _ in range(2))
        made = np.full(len(self.head), -1, np.int64)  # the rank that makes it
        self.head[self.first] = self.tail[self.first] = np.arange(256)
        places = np.arange(len(pairs))
        for a, b, c, k in zip(left.tolist(), right.tolist(), self.into.tolist(), places.tolist()):
            self.head[c], self.tail[c], made[c] = self.head[a], self.tail[b], k
        # where every merge comes after those that make its parts, ranks only
        # rise, and a pair of which no neighbour can come first needs no waiting
        self.rising = bool((np.maximum(made[left], made[right]) < places).all()) and len(np.unique(self.into)) == len(pairs)
        self.after = Guards(left << 8 | self.head[right], places)
        self.before = Guards(right << 8 | self.tail[left], places)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left << 20 | right
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.rank[at], NONE)

    def survivors(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How many symbols remain of each sequence.

        A round applies each sequence's lowest-ranked pair at all its places,
        and with it every pair that is certain to be applied before anything
        touches it.  Symbols are linked in arrays and a round looks only at
        places that still have a pair, so long sequences take few cheap rounds.
        """
        n, lengths = len(symbols), lengths.astype(np.int64)
        ends = np.cumsum(lengths)
        own = np.repeat(np.arange(len(lengths)), lengths)
        # one place more stands beyond both ends of every sequence
        sym, rank = np.append(symbols, 0), np.full(n + 1, NONE)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[n] = before[0] = n
        full = lengths > 0
        after[ends[full] - 1], before[(ends - lengths)[full]] = n, n
        left = lengths.copy()
        live = np.flatnonzero(after[:n] != n)
        rank[live] = self.ranks(sym[live], sym[live + 1])
        live = check = live[rank[live] != NONE]
        while len(live):
            r, of = rank[live], own[live]
            edge = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            least = np.repeat(np.minimum.reduceat(r, edge), np.diff(np.append(edge, len(live))))
            # equal neighbours overlap: of a run of places take every other one
            at = live[r == least]
            opens = np.ones(len(at), bool)
            opens[1:] = after[at[:-1]] != at[1:]
            run = np.cumsum(opens) - 1
            at = at[(np.arange(len(at)) - np.flatnonzero(opens)[run]) % 2 == 0]
            if self.rising:
                at = _sorted_set(at, self._certain(check, sym, rank, before, after))
            gone = after[at]
            sym[at], rank[gone] = self.into[rank[at]], NONE
            beyond = after[gone]
            after[at] = beyond
            inside = beyond != n
            before[beyond[inside]] = at[inside]
            np.subtract.at(left, own[at], 1)
            rank[at] = NONE
            fresh = _sorted_set(at, before[at])  # their pairs have changed
            fresh = fresh[after[fresh] != n]
            rank[fresh] = self.ranks(sym[fresh], sym[after[fresh]])
            # what was not certain may be so now, up to two places away
            one, other = before[fresh], after[fresh]
            check = _sorted_set(fresh, one, other, before[one], after[other])
            check = check[rank[check] != NONE]
            place = np.minimum(np.searchsorted(live, fresh), len(live) - 1)
            more = fresh[live[place] != fresh]
            live = np.insert(live, np.searchsorted(live, more), more)
            live = live[rank[live] != NONE]
        return left

    def _certain(self, places, sym, rank, before, after) -> np.ndarray:
        """Those of the pairs that nothing next to them can forestall.

        A neighbour keeps the byte that it touches the pair with, whatever it
        grows to.  It can come first only if some merge with a symbol of that
        byte ranks lower than the pair, and if it can itself grow before.
        """
        beyond = len(sym) - 1
        r = rank[places]
        at = places[(r < rank[before[places]]) & (r < rank[after[places]])]
        for link, guard, near in ((before, self.before, self.tail), (after, self.after, self.head)):
            inner = at if link is before else after[at]
            beside = link[inner]
            outer = link[beside]
            # beyond the last neighbour there is nothing that it could grow with
            held = np.flatnonzero((beside != beyond) & (outer != beyond))
            r, beside, outer = rank[at[held]], sym[beside[held]], sym[outer[held]]
            free = (guard(sym[inner[held]], near[beside]) > r) | (guard(beside, near[outer]) >= r)
            at = np.delete(at, held[~free])
        return at


@cache
def merges(path: str) -> Merges:
    return Merges(path)


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of each byte's character."""
    known = classes()
    out = known[:256].copy()
    out[128:] = OTHER
    out = out[data]
    high = np.flatnonzero(data >= 0x80)
    if len(high):
        wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
        lead = high[data[high] >= 0xC0]
        b0, b1, b2, b3 = (wide[lead + k] for k in range(4))
        more = [b & 0x3F for b in (b1, b2, b3)]
        point = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | more[0], np.where(b0 < 0xF0, (b0 & 0xF) << 12 | more[0] << 6 | more[1], (b0 & 7) << 18 | more[0] << 12 | more[1] << 6 | more[2]))
        kind = known[np.minimum(point, 0x10FFFF)]
        out[lead] = kind
        out[lead + 1] = kind
        for k, from_ in ((2, 0xE0), (3, 0xF0)):
            sel = b0 >= from_
            out[lead[sel] + k] = kind[sel]
    return out


def pre_tokens(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of `PATTERN`, rows being texts of their own."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(data)
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start[off[:-1][off[:-1] < n]] = True
    # runs of white space before something else: the last character stands
    # alone, or, being a blank, goes with what follows
    a, b = texts.runs(kind == SPACE, off)
    ends = np.zeros(n + 1, bool)
    ends[off] = True
    inside = ~ends[b]
    b = b[inside]
    last = b - 1
    for _ in range(3):
        last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
    start[last] = True
    start[b[data[last] == 0x20]] = False
    # contractions, at a quote that begins a pre-token
    q = np.flatnonzero((data == 0x27) & start)
    if len(q):
        wide = np.concatenate([data, np.zeros(2, np.uint8)])
        bound = off[np.searchsorted(off, q, "right")]
        one, two = wide[q + 1], wide[q + 2]
        short = np.isin(one, list(b"stmd"))
        long = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        size = np.where(short, 2, np.where(long, 3, 0))
        ok = (size > 0) & (q + size <= bound)
        q, size, bound = q[ok], size[ok], bound[ok]
        start[q + 1] = False
        more = q + size < bound
        start[(q + size)[more]] = True
    return np.flatnonzero(start)


def specials(data: np.ndarray, off: np.ndarray, known: list[tuple[bytes, int]]) -> list[tuple[int, int, int]]:
    """(start, end, id) of special strings, leftmost first, within rows."""
    import re

    if not known or not len(data):
        return []
    raw = data.tobytes()
    found, wanted = [], re.compile(b"|".join(re.escape(s) for s, _ in sorted(known, key=lambda x: -len(x[0]))))
    ids, at = dict(known), 0
    while m := wanted.search(raw, at):
        row = np.searchsorted(off, m.start(), "right")
        if m.end() <= off[row]:
            found.append((m.start(), m.end(), ids[m.group()]))
            at = m.end()
        else:
            at = int(off[row])
    return found


class Counter:
    """Counts tokens of blocks, keeping the counts of pre-tokens seen."""

    def __init__(self, path: str):
        self.merges = merges(path)
        self.index = texts.HashIndex(np.zeros(0, np.uint64))
        self.count = np.zeros(0, np.int32)

    def __call__(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        rows = len(off) - 1
        if not len(data):
            return np.zeros(rows, np.int64)
        marks = specials(data, off, self.merges.special)
        cuts, drop = off, np.zeros(0, np.int64)
        if marks:
            drop = np.array([m[0] for m in marks])
            cuts = np.unique(np.concatenate([off, drop, [m[1] for m in marks]]))
        start = pre_tokens(data, cuts)
        end = np.append(start[1:], len(data))
        n = self._tokens(data, start, end)
        if len(drop):
            whole = np.isin(start, drop)
            inner = (np.searchsorted(drop, start, "right") > 0) & ~whole
            where = np.maximum(np.searchsorted(drop, start, "right") - 1, 0)
            inner &= start < np.array([m[1] for m in marks])[where]
            n = np.where(whole, 1, np.where(inner, 0, n))
        total = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        at = texts.per_row(start, off)
        return total[at[1:]] - total[at[:-1]]

    def _tokens(self, data, start, end):
        running = texts.prefix_hash(texts.table(5)[data])
        h = texts.span_hash(running, start, end)
        at = self.index.find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            keys, where = np.unique(h[new], return_index=True)
            size, first = (end - start)[new][where], start[new][where]
            counts = np.empty(len(keys), np.int32)
            total = np.cumsum(size)
            low = 0
            while low < len(keys):  # in portions, so that arrays stay small
                high = max(low + 1, int(np.searchsorted(total, total[low] + MERGE_SYMBOLS)))
                group, place = texts.ragged(size[low:high])
                symbols = self.merges.first[data[first[low:high][group] + place]]
                counts[low:high] = self.merges.survivors(symbols, size[low:high])
                low = high
            if len(keys) + len(self.count) > STORE_ENTRIES:
                self.index, self.count = texts.HashIndex(np.zeros(0, np.uint64)), np.zeros(0, np.int32)
                return self._again(h, keys, counts, data, start, end)
            self._add(keys, counts)
            at = self.index.find(h)
        return self.count[at].astype(np.int64)

    def _add(self, keys, counts):
        keys, self.count = texts.merged(self.index.keys, self.count, keys, counts)
        self.index = texts.HashIndex(keys)

    def _again(self, h, keys, counts, data, start, end):
        """The store was emptied: what it knew is counted anew for this block."""
        self._add(keys, counts)
        at = self.index.find(h)
        out = np.zeros(len(h), np.int64)
        out[at >= 0] = self.count[at[at >= 0]]
        rest = np.flatnonzero(at < 0)
        if len(rest):
            unique, where, back = np.unique(h[rest], return_index=True, return_inverse=True)
            size, first = (end - start)[rest][where], start[rest][where]
            group, place = texts.ragged(size)
            counted = self.merges.survivors(self.merges.first[data[first[group] + place]], size)
            out[rest] = counted[back]
        return out


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens.

    ``vocabulary`` names a byte-level merge file of the installed vocabularies;
    special strings inside a text count as one token each.
    """
    frame = shared.pick(docs, doc_id=doc_id, text=text)
    schema = T.StructType([T.StructField("doc_id", frame.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary_path(vocabulary)
        counter = texts.hold(("counts", path), lambda: Counter(path))  # what it knows serves later tasks
        for batch in batches:
            for piece, data, off in texts.blocks(batch, "text", texts.STORE_BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(off)), pa.array(counter(data, off))], names=["doc_id", "n_bytes", "n_tokens"])

    return frame.mapInArrow(run, schema)


def op5_token_counts(spark: SparkSession, sf_dir: str, limit: int = 1024) -> DataFrame:
    return count_tokens(shared.documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > limit)
