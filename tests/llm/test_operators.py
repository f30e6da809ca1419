"""The operators over the smallest tables, against plain versions."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import decontaminate, fingerprint, jaccard, language, lm_score, packing, quality, registry, sample, shared, suffix_dedup, texts, tokens, toxicity

from . import brute

MIX = " '\n\tsretmdlv01é!<|>Ñ"


def noise(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(MIX) for _ in range(rng.randint(0, 60))) for _ in range(n)]


SPECIAL = ["", " ", "it's we're they'll I'd 'tis ''s !'s 'S can't", "x y　z  .", "ab<|endoftext|>cd <|endoftext|> e<|endoftext", "aaaaaaaaaa" * 90, "日本語 12345 ½ ٣٤", "é́x İ ΑΣ ǅ", "\r\n  \n a", "a\x85b\x1cc d", "  's", "'s's"]


def batch(values):
    return pa.record_batch({"text": pa.array(values, pa.string())})


def test_fingerprints_tell_edits_from_others(spark, sf):
    got = fingerprint.op1_quartile_digest(spark, sf).toPandas()
    assert (got.near_edited > got.near_next).mean() > 0.97
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()


def test_digests_and_likeness(spark, small, sf):
    """Against plain versions, whole table; the next document as well as the edited text."""
    order = small.sort_values("doc_id", ascending=False)
    values = dict(zip(order.doc_id, order.text))
    follows = dict(zip(order.doc_id, [*order.doc_id[1:], order.doc_id.iloc[0]]))
    for r in fingerprint.op1_quartile_digest(spark, sf).collect():
        mine, other = values[r["doc_id"]], values[follows[r["doc_id"]]]
        edited = mine[: len(mine) - len(mine) // 3] + other[: len(mine) // 3]
        assert (r["n_chars"], r["fingerprint"], r["edited_fingerprint"]) == (len(mine), brute.digest_hex(mine), brute.digest_hex(edited))
        assert math.isclose(r["near_edited"], brute.digest_likeness(mine, edited), abs_tol=1e-9)
        assert math.isclose(r["near_next"], brute.digest_likeness(mine, other), abs_tol=1e-9)


@pytest.mark.parametrize("kind", ["int", "string", "decimal(20,0)", "date"])
def test_digests_of_any_id(spark, kind):
    rows = spark.range(50).selectExpr("cast(id as string) as k", "concat('text number ', id) as text")
    made = "date_add(date'2020-01-01', cast(k as int))" if kind == "date" else f"cast(k as {kind})"
    frame = rows.selectExpr(f"{made} as doc_id", "text")
    got = fingerprint.compare_edited(frame)
    assert got.schema["doc_id"].dataType == frame.schema["doc_id"].dataType and {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in frame.collect()}


def test_next_over_many_ranges(spark, small, sf):
    order = small.sort_values("doc_id", ascending=False)
    values = order.text.tolist()
    want = {d: brute.sha((a[: len(a) - len(a) // 3] + b[: len(a) // 3]).encode()) for d, a, b in zip(order.doc_id, values, values[1:] + values[:1])}
    got = fingerprint.op1_quartile_digest(spark, sf).collect()
    assert {r["doc_id"]: r["edited_sha256"] for r in got} == want


def test_token_counts(small):
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path(tokens.VOCABULARY)
    values = small.text.tolist() + SPECIAL + noise(2000)
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(values, add_special_tokens=False)]
    counter = tokens.Counter(path)
    assert np.concatenate([counter(d, o) for _, d, o in texts.blocks(batch(values), "text", 50_000)]).tolist() == want


def test_long_words_are_counted_in_time():
    """Words of 1 MB without a break: rounds must not grow with their length."""
    import time

    from tokenizers import Tokenizer

    path = tokens.vocabulary_path(tokens.VOCABULARY)
    library, rng = Tokenizer.from_file(path), random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for value in ("".join(rng.choices(letters, k=1 << 20)), "a" * (1 << 20), "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(350_000))):
        began = time.perf_counter()
        want = len(library.encode(value, add_special_tokens=False).ids)
        theirs = time.perf_counter() - began
        began = time.perf_counter()
        got = [tokens.Counter(path)(d, o).tolist() for _, d, o in texts.blocks(batch([value]), "text")]
        assert got == [[want]] and time.perf_counter() - began < 20 * theirs


def test_merging_early_changes_nothing(small):
    """With and without the pairs that are certain ahead of their turn."""
    made = tokens.merges(tokens.vocabulary_path(tokens.VOCABULARY))
    rng = random.Random(8)
    words = [w.encode() for w in set(" ".join(small.text).split())][:3000] + ["".join(rng.choices("abcdeéñ'", k=rng.randrange(1, 90))).encode() for _ in range(2000)]
    symbols, lengths = made.first[np.frombuffer(b"".join(words), np.uint8)], np.array([len(w) for w in words])
    assert made.rising
    early = made.survivors(symbols, lengths)
    made.rising = False
    try:
        assert made.survivors(symbols, lengths).tolist() == early.tolist()
    finally:
        made.rising = True


def test_token_query(spark, small, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary_path(tokens.VOCABULARY))
    want = {d: len(e.ids) for d, e in zip(small.doc_id, library.encode_batch(small.text.tolist(), add_special_tokens=False))}
    got = tokens.op5_token_counts(spark, sf).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == {d: (len(t.encode()), want[d], want[d] > 1024) for d, t in zip(small.doc_id, small.text)}


def test_token_store_starts_anew(small, monkeypatch):
    monkeypatch.setattr(tokens, "STORE_ENTRIES", 500)
    path = tokens.vocabulary_path(tokens.VOCABULARY)
    values = small.text.tolist()
    few, whole = tokens.Counter(path), tokens.Counter(path)
    got = [c(d, o) for c, size in ((few, 20_000), (whole, 1 << 22)) for _, d, o in texts.blocks(batch(values), "text", size) for c in [c]]
    assert np.concatenate(got)[: len(values)].tolist() == np.concatenate(got)[len(values) :].tolist()


def test_ids_are_the_library_s(small):
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path(packing.VOCABULARY)
    values = small.text.tolist() + SPECIAL + noise(2000, 2)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(values, add_special_tokens=False)]
    encoder, got = packing.Encoder(path), []
    for _, d, o in texts.blocks(batch(values), "text", 100_000):
        ids, edge = encoder(d, o)
        got += [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:])]
    assert got == want


@pytest.mark.parametrize("group", [50_000, 40])
def test_packing_round_trip(spark, small, sf, group):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary_path(packing.VOCABULARY))
    ids = {d: [*library.encode(t, add_special_tokens=False).ids, 1] for d, t in zip(small.doc_id, small.text)}
    got = packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), group=group).toPandas()
    for d, part in got.sort_values(["doc_id", "piece"]).groupby("doc_id"):
        assert part.piece.tolist() == list(range(len(part))) and part.length.sum() == len(ids[d])
        for r in part.itertuples():
            piece = ids[d][r.start : r.start + r.length]
            assert len(piece) == r.length and zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32
        assert (part.length.iloc[:-1] == packing.CAPACITY).all()
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() <= packing.CAPACITY
    assert got.sequence_id.nunique() <= packing.lower_bound(got.length.to_numpy()) + 2


def test_packing_of_equal_rows(spark, monkeypatch):
    """Two million rows that are all alike: groups stay bounded, numbers unique."""
    sizes, packer = spark.sparkContext.accumulator(0), packing._packer

    def watched(*args):
        run = packer(*args)

        def counted(table):
            sizes.add(int(table.num_rows > 60_000))
            return run(table)

        return counted

    monkeypatch.setattr(packing, "_packer", watched)
    docs = spark.range(2_000_000).selectExpr("cast(7 as long) as doc_id", "'same words here' as text")
    got = packing.pack(docs).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.countDistinct("offset").alias("places"), F.count(F.lit(1)).alias("rows"))
    total, most, torn, bins = got.selectExpr("sum(rows)", "max(n)", "sum(int(n != end or places != rows))", "count(*)").first()
    each = len(packing._library(tokens.vocabulary_path(packing.VOCABULARY)).encode("same words here", add_special_tokens=False).ids) + 1
    assert total == 2_000_000 and most <= packing.CAPACITY and torn == 0 and sizes.value == 0
    assert bins <= -(-total // (packing.CAPACITY // each)) + 1


def test_bounds_and_best_fit():
    rng = np.random.default_rng(3)
    for low, high in ((1, 4096), (1400, 2100), (1, 50), (2049, 4096)):
        lengths = rng.integers(low, high + 1, 300)
        bins, offsets, used = packing.best_fit(lengths)
        assert packing.lower_bound(lengths) <= used and np.bincount(bins, weights=lengths).max() <= 4096
        assert used == bins.max() + 1
    assert packing.lower_bound(np.full(10, 2049)) == 10 and packing.lower_bound(np.full(9, 1366)) == 5


@pytest.mark.parametrize("blocks", [False, True])
def test_jaccard_components(spark, small, sf, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(jaccard, "CLUSTER", 3)
        monkeypatch.setattr(jaccard, "BLOCK", 2)
    got = jaccard.op3_jaccard_join(spark, sf).toPandas().set_index("doc_id").loc[small.doc_id]
    n, component = brute.components(small.doc_id.tolist(), small.text.tolist())
    assert got.n_shingles.tolist() == n and got.component_id.tolist() == component


def test_jaccard_of_a_large_cluster(spark):
    """More near copies of one text than a task joins."""
    words = [f"w{k}" for k in range(60)]
    docs = spark.range(6000).selectExpr("id as doc_id", f"concat('{' '.join(words[:40])} v', id, ' {' '.join(words[40:])}') as text")
    got = jaccard.link_components(docs).groupBy("component_id").count().collect()
    assert [(r["component_id"], r["count"]) for r in got] == [(0, 6000)]


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_near_the_threshold(spark, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(3)]
    rows = []
    for k in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            w[rng.randrange(len(w))] = f"v{rng.randrange(30)}"
        rows.append((k, " ".join(w[: rng.choice((60, 60, 58, 55))])))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d] for d, _ in rows] == brute.components(*zip(*rows))[1]


def test_decontamination(spark, small, sf):
    import pandas as pd

    items = list(pd.read_parquet(f"{sf}/benchmark.parquet").itertuples(index=False, name=None))
    got = {r["doc_id"]: r for r in decontaminate.op4_decontaminate(spark, sf).collect()}
    some = small[small.doc_id.isin([d for d, r in got.items() if r["n_hit"] or d % 20 == 0])]
    for d, t in zip(some.doc_id, some.text):
        words, hit, found = brute.contamination(t, items)
        sha = brute.sha(",".join(sorted(map(str, found))).encode())
        assert tuple(got[d])[1:] == (words, hit, len(found), sha, hit > 0)


def test_decontamination_in_several_passes(spark, sf, monkeypatch):
    whole = {tuple(r) for r in decontaminate.op4_decontaminate(spark, sf).collect()}
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", 2000)
    assert {tuple(r) for r in decontaminate.op4_decontaminate(spark, sf).collect()} == whole


def test_suffix_dedup(spark, small, sf):
    got = suffix_dedup.op7_suffix_dedup(spark, sf).toPandas().set_index("doc_id")
    masks = brute.removed(small.doc_id.tolist(), small.text.tolist())
    for d, t, m in zip(small.doc_id, small.text, masks):
        assert tuple(got.loc[d]) == (len(t.encode()), sum(m), brute.spans(m), brute.sha(brute.kept(t, m)))


def test_doubling_over_all_positions(spark, small, sf):
    """The plain rounds find the same windows as brute force, and the operator's bytes."""
    some = small[small.text.str.len() < 1500]
    frame = spark.createDataFrame(some[["doc_id", "text"]])
    got = {(r["doc_id"], r["start"]) for r in suffix_dedup.covered_by_doubling(frame).collect()}
    raw, first = {d: t.encode() for d, t in zip(some.doc_id, some.text)}, {}
    for d in sorted(raw):
        for k in range(len(raw[d]) - 49):
            first.setdefault(raw[d][k : k + 50], d)
    assert got == {(d, k) for d, b in raw.items() for k in range(len(b) - 49) if first[b[k : k + 50]] < d} and got
    gone = Counter()
    for d in {d for d, _ in got}:
        gone[d] = len({k + j for e, k in got if e == d for j in range(50)})
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(frame).collect() if r["n_removed"]} == dict(gone)


def test_windows_settled_in_their_task(spark):
    """Very many documents around one passage, each with borders of its own."""
    rng = random.Random(4)
    passage = "".join(rng.choices("abcdefgh ", k=400))
    rows = [(k, "".join(rng.choices("ijklmn", k=rng.choice((3, 30, 60)))) + passage[rng.choice((0, 7, 90)) : rng.choice((300, 390, 400))] + "".join(rng.choices("opqrst", k=20))) for k in range(300)]
    masks = brute.removed(*zip(*rows))
    for parts in (1, 7):
        got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert {r["doc_id"]: bytes(r["kept"]) for r in got} == {d: brute.kept(t, m) for (d, t), m in zip(rows, masks)}
    assert not [t.name for t in spark.catalog.listTables() if "lodegraph" in t.name]


def test_suffix_second_round(spark, small):
    """Texts of few words, whose 24 bytes meet by chance: a second round comes, and bytes are those of brute force."""
    rng = random.Random(8)
    words = ["the", "and", "a", "of", "tion"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(60)
    rows = [(k, text(rng.randint(0, 300)) + (passage[rng.randint(0, 40) :] + text(9) if k % 3 else "é")) for k in range(120)] + [(7, passage), (7, passage), (-5, passage + "ñ"), (2**62, text(200))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    masks = brute.removed(*zip(*rows))
    want = sorted((d, brute.kept(t, m)) for (d, t), m in zip(rows, masks))
    for sparse in (0, 16, 1 << 40):  # never, as it comes, always
        assert sorted((r["doc_id"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(frame, sparse=sparse).collect()) == want


def test_suffix_shuffle_stays_small():
    """A table's many buckets don't make an anchor larger, and strings that meet by chance are few."""
    rng = random.Random(3)
    words = ["".join(rng.choice(["tion", "er", "the", "on", "an", "re", "in", "ea"]) for _ in range(rng.randint(1, 3))) for _ in range(500)]
    rows = [" ".join(rng.choice(words) for _ in range(600)) for _ in range(700)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(700) % 7 << 33 | np.arange(700)), pa.array(np.arange(700)), pa.array(rows)], names=["rid", "doc_id", "text"])
    sent = list(suffix_dedup._deal_anchors(600, 50, suffix_dedup.GRAM)(iter([batch])))
    size = sum(len(pa.compress(b"".join(b.column(k)[0].as_py() for k in range(1, b.num_columns)), "lz4_raw", asbytes=True)) for b in sent)
    assert size < sum(map(len, rows))


def test_shuffles_are_freed(spark):
    """What a stage shuffled leaves the disk when its table is written."""
    files = lambda: sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before = files()
    table = shared.Stage(spark, "test").write(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    assert table.count() == 7


def test_lm_base_and_score(spark, small, sf):
    got = lm_score.op2_context_tree(spark, sf).toPandas().set_index("doc_id").loc[small.doc_id]
    aside = [brute.held_out(d, 5, 1) for d in small.doc_id]
    counts, ends = Counter(), 0
    for t, h in zip(small.text, aside):
        if not h:
            counts.update(brute.plain_words(t))
            ends += 1
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    cost = lambda c: math.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
    for r, t, h in zip(got.itertuples(), small.text, aside):
        w = brute.plain_words(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, len(w) + 1, sum(counts[x] > 0 for x in w) + 1, total)
        assert math.isclose(r.base_score, sum(cost(counts[x]) for x in w) + cost(ends), rel_tol=1e-9)
        assert r.score < 0


def test_lm_in_small_chunks_and_split_contexts(spark, sf):
    """However the texts are cut into chunks, buckets and subtrees, the sums are the same."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = lm_score.score(docs, common_share=1.0).toPandas().sort_values("doc_id", ignore_index=True)
    parts = lm_score.score(docs, chunk_bytes=20_000, bucket_bytes=10_000, common_share=0.002).toPandas().sort_values("doc_id", ignore_index=True)
    assert np.allclose(whole.score, parts.score) and np.allclose(whole.base_score, parts.base_score) and (whole.n_known == parts.n_known).all()


def test_lm_buckets_stay_small(spark, monkeypatch):
    """A bucket's share of the grams does not follow that of a common context of three bytes."""
    rng, made = random.Random(5), []
    rows = [(k, "".join("the" + "".join(rng.choices("abcdefghijklmnop", k=3)) for _ in range(400))) for k in range(100)]
    docs, write = spark.createDataFrame(rows, "doc_id long, text string"), shared.Stage.write
    monkeypatch.setattr(shared.Stage, "write", lambda self, frame, **more: made.append(write(self, frame, **more)) or made[-1])
    got = lm_score.score(docs, chunk_bytes=20_000, bucket_bytes=2_000, common_share=0.004).toPandas().sort_values("doc_id", ignore_index=True)
    most, every = made[-1].where("kind = 0").agg(F.max("total"), F.sum("total")).first()
    assert most < 0.08 * every  # a sixth of the bytes follow "the"
    files = made[0].groupBy(F.input_file_name()).count().agg(F.max("count"), F.sum("count")).first()
    assert files[0] <= 2 and files[1] > 8  # rows of a file are read at once
    whole = lm_score.score(docs, common_share=1.0).toPandas().sort_values("doc_id", ignore_index=True)
    assert np.allclose(whole.score, got.score)


def test_lm_packs_numbers():
    rng = np.random.default_rng(2)
    for values in (np.zeros(3, np.uint64), np.array([2**63, 5], np.uint64), rng.integers(0, 2**20, 1000).astype(np.uint64)):
        assert (lm_score._numbers(lm_score._whole(values)) == values).all()
        assert (lm_score._places(lm_score._rising(np.sort(values))) == np.sort(values)).all()


def plain_weighting(train, text, depth):
    """Context-tree weighting of single texts, with dictionaries."""
    nodes = {}

    def path(context, prefix):
        return [(context[len(context) - d :], prefix) for d in range(depth + 1)]

    def symbols(raw):
        padded = bytes([255] * depth) + raw + b"\xff"
        for k in range(depth, len(padded)):
            prefix = ""
            for j in range(8):
                bit = padded[k] >> (7 - j) & 1
                yield padded[k - depth : k], prefix, bit
                prefix += str(bit)

    for raw in train:
        for context, prefix, bit in symbols(raw):
            for key in path(context, prefix):
                nodes.setdefault(key, [0, 0])[bit] += 1
    log_kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
    below, weighted, own = {}, {}, {}
    for d in range(depth, -1, -1):
        for (context, prefix), (a, b) in [x for x in nodes.items() if len(x[0][0]) == d]:
            e = log_kt(a, b)
            w = e if d == depth else np.logaddexp(e, below[context, prefix]) + math.log(0.5)
            weighted[context, prefix], own[context, prefix] = w, math.exp(math.log(0.5) + e - w) if d < depth else 1.0
            if d:
                below[context[1:], prefix] = below.get((context[1:], prefix), 0) + w
    total = 0.0
    for context, prefix, bit in symbols(text):
        p = None
        for key in reversed(path(context, prefix)):
            if key in nodes:
                a, b = nodes[key]
                e = ((b if bit else a) + 0.5) / (a + b + 1)
                p = e if p is None else own[key] * e + (1 - own[key]) * p
        total += math.log10(0.5 if p is None else p)
    return total


def test_lm_is_context_tree_weighting(spark):
    rows = [(k, t) for k, t in enumerate(["abracadabra abra", "the cat sat on the mat", "cat and rat", "", "ééé", "mat cat"])]
    got = {r["doc_id"]: r["score"] for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    train = [t.encode() for d, t in rows if not brute.held_out(d, 5, 1)]
    for d, t in rows:
        assert math.isclose(got[d], plain_weighting(train, t.encode(), lm_score.DEPTH), rel_tol=1e-4)


def held_out_rows(spark, query, sf, column, remainder, modulus):
    import pandas as pd

    got = query(spark, sf).toPandas()
    assert got.held_out.tolist() == [brute.held_out(d, modulus, remainder) for d in got.doc_id]
    if column == "lang":
        return got[got.held_out].merge(pd.read_parquet(f"{sf}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    return got[got.held_out].merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")


def area(label, score):
    rank = np.argsort(np.argsort(score)) + 1
    one = label == 1
    return (rank[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())


LARGER = "/root/testdata/sf0.01"


def test_quality_is_ftrl(small):
    """Weights and bias against dictionaries, over the first texts."""
    rows = [(t, k % 3 // 2) for k, t in enumerate(small.text[:60])]

    def numbers(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return quality.features(data, np.array([0, len(data)]))[0].tolist()

    weights, bias = quality.fit(rows, 2)
    want, want_bias = brute.follow_the_leader(rows, numbers, 2, quality.ALPHA, quality.BETA, quality.L1, quality.L2)
    assert np.allclose([weights[k] for k in want], list(want.values()), atol=1e-9) and math.isclose(bias, want_bias, rel_tol=1e-9)
    assert np.count_nonzero(weights) == sum(w != 0 for w in want.values()) > 0


def test_quality_features():
    """A feature a word and one for each pair of neighbours; the same word twice is one of its own."""
    text = b"Aa b  b\nAa b c"
    got, first = quality.features(np.frombuffer(text + b"Aa b", np.uint8), np.array([0, len(text), len(text) + 4]))
    a, b, ab, bb = got[0], got[1], got[2], got[4]
    assert first.tolist() == [0, 11, 14] and len({*got[:11].tolist()}) == 7
    assert got[11:].tolist() == [a, b, ab] and bb == int(quality.AGAIN & np.uint64((1 << quality.BITS) - 1)) and got[8] == ab


def plain_toxicity(rows, epochs, least_met, seed=6):
    """Joint training of vectors and softmax, a text and a coordinate at a time."""
    one = lambda raw, salt: int(texts.span_hash(texts.prefix_hash(texts.table(salt)[np.frombuffer(raw, np.uint8)]), np.array([0]), np.array([len(raw)]))[0] >> np.uint64(64 - toxicity.BITS))
    bag = {}

    def buckets(word):
        if word not in bag:
            padded = f"<{word}>"
            bag[word] = [one(word.encode(), 6)] + [one(padded[k : k + n].encode(), 66) for n in (3, 4, 5) for k in range(len(padded) - n + 1)]
        return bag[word]

    split = [[w for w in re.split(r"[\x20\x09-\x0D.,;:!?()\[\]{}\"'|]+", brute.ascii_lower(t).decode()) if w] for t, _ in rows]
    met = Counter(b for words in split for w in set(words) for b in buckets(w))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (1 << toxicity.BITS, toxicity.SIZE)).astype(np.float32).astype(float)
    column = rng.normal(0, 0.5, toxicity.SIZE)
    ones = sum(y for _, y in rows)
    bias = math.log((ones + 1) / (len(rows) - ones + 1))
    seen, seen_column, seen_bias = defaultdict(lambda: np.full(toxicity.SIZE, toxicity.FLOOR)), np.full(toxicity.SIZE, 1.0), 1.0
    for epoch in range(epochs):
        order, rate = rng.permutation(len(rows)), toxicity.RATE * (1 - epoch / epochs)
        for low in range(0, len(order), toxicity.BATCH):
            pull, total = defaultdict(float), 0.0
            for k in order[low : low + toxicity.BATCH]:
                share = Counter()
                for w in split[k]:
                    for b in buckets(w):
                        if met[b] >= least_met:
                            share[b] += toxicity.SCALE / (len(split[k]) * len(buckets(w)))
                g = 1 / (1 + math.exp(-(sum(table[b] @ column * s for b, s in share.items()) + bias))) - rows[k][1]
                total += g
                for b, s in share.items():
                    pull[b] += g * s
            step_column = sum((table[b] * p for b, p in pull.items()), np.zeros(toxicity.SIZE))
            for b, p in pull.items():
                seen[b] += (p * column) ** 2
                table[b] -= rate * p * column / np.sqrt(seen[b])
            seen_column += step_column**2
            column = column - rate * step_column / np.sqrt(seen_column)
            seen_bias += total**2
            bias -= rate * total / math.sqrt(seen_bias)
    return {b: (table[b] @ column) * toxicity.SCALE for b in met if met[b] >= least_met}, bias


@pytest.mark.parametrize("least_met", [1, 5])
def test_toxicity_is_trained_jointly(small, least_met):
    rows = [(t[:200], k % 3 // 2) for k, t in enumerate(small.text[:100])]
    share, bias = toxicity.fit(rows, 3, least_met=least_met)
    want, want_bias = plain_toxicity(rows, 3, least_met)
    got = np.array([share[b] for b in want])
    assert np.allclose(got, list(want.values()), rtol=2e-3, atol=2e-3) and math.isclose(bias, want_bias, abs_tol=2e-4)
    assert np.count_nonzero(share) <= len(want)


def test_sample_passes_over(spark):
    """Labels without a document, texts above their share, rows of one id."""
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 50 = 7, repeat('x', 20000), concat('text ', id)) as text")
    docs = docs.union(spark.range(5000).selectExpr("cast(11 as long)", "concat('copy ', id)"))
    labels = spark.range(200_000).selectExpr("id * 10 as doc_id", "cast(id % 2 as int) as toxic").union(docs.limit(3000).selectExpr("doc_id", "cast(doc_id % 2 as int)"))
    rows = sample.labelled(docs, labels, "toxic", None, 5, 800, 100_000)
    assert len(rows) == 800 and all(len(t) < 20000 for t, _ in rows) and sum(t.startswith("copy") for t, _ in rows) <= 1
    few = sample.labelled(docs, labels, "toxic", None, 5, 800, 4000)
    assert few == rows[: len(few)] and 3500 < sum(len(t) for t, _ in few) <= 4000


def test_language_is_kneser_ney(small):
    rows = [(t[:300], k) for t, k in zip(small.text[:80], small.lang[:80])]
    plain = brute.KneserNey(rows)
    model = language.Model(plain.names, [(t, plain.names.index(k)) for t, k in rows])
    values = [t[:120] for t in small.text[80:110]] + ["ÅØ zzz 日本語", "q"]
    got = np.concatenate([model.entropies(d, o)[0] for _, d, o in texts.blocks(batch(values), "text")])
    want = [[plain.entropy(k, t) for k in plain.names] for t in values]
    assert np.allclose(got, want, rtol=1e-4)


def test_one_very_long_text_is_learned(spark):
    """At the default bounds, whatever the id of the only text of its language."""
    english = [(k, "en", f"the cat and the dog number {k} sat on the mat") for k in range(50)]
    spanish = "el perro y el gato duermen en la casa blanca " * 250_000
    for doc_id in (2000, 2003, 2004, 2006):
        frame = spark.createDataFrame([*english, (doc_id, "es", spanish)], "doc_id long, lang string, text string")
        if brute.held_out(doc_id, 3, 1):
            continue
        assert language.learn(frame, 1, 3, language.SAMPLE_ROWS, language.SAMPLE_BYTES, "doc_id", "text", "lang").names == ["en", "es"]


def test_language_sample_is_bounded(spark):
    """One id with very many rows is one row of the sample, and shares are kept."""
    rows = spark.range(30_000).selectExpr("cast(5 as long) as doc_id", "'en' as lang", "concat('word ', id) as text").union(spark.range(9000).selectExpr("id + 10", "if(id % 9 = 0, 'fr', 'en')", "concat('mot ', id)"))
    got = []
    model = language.Model
    try:
        language.Model = lambda names, sampled: got.extend(sampled) or model(names, sampled)
        language.learn(rows, None, 3, 1000, 1 << 20, "doc_id", "text", "lang")
    finally:
        language.Model = model
    assert 850 <= len(got) <= 900 + 2 and sum(t.startswith("word") for t, _ in got) <= 1


def test_quality_held_out(spark):
    got = held_out_rows(spark, quality.op8_quality, LARGER, "quality", 0, 5)
    assert area(got.quality.to_numpy(), got.score.to_numpy()) > 0.9
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()


def test_toxicity_held_out(spark):
    got = held_out_rows(spark, toxicity.op6_toxicity, LARGER, "toxic", 0, 5)
    assert area(got.toxic.to_numpy(), got.score.to_numpy()) > 0.75


def test_toxicity_learns_from_32_mb(spark):
    docs = spark.range(12).selectExpr("id as doc_id", "repeat('word ', 400000) as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    rows = sample.picked(docs, labels, "toxic", None, 5, toxicity.SAMPLE_ROWS, toxicity.SAMPLE_BYTES)
    assert rows.count() == 12  # 24 MB


def test_toxicity_is_fitted_on_an_executor(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    bounds = (docs, labels, "toxic", 0, 5, 12_000, 32 << 20)
    share, bias = toxicity.learn(sample.picked(*bounds))
    want, want_bias = toxicity.fit(sample.labelled(*bounds))
    assert np.allclose(share, want) and np.isclose(bias, want_bias)


def test_misspellings_share_grams():
    rng = random.Random(7)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)]
    rows = []
    for k in range(400):
        w = [rng.choice(plain) for _ in range(30)]
        if k % 4 == 0:
            w[rng.randrange(30)] = rng.choice(("worthless", "worthles", "wworthless"))
        rows.append((" ".join(w), int(k % 4 == 0)))
    scorer = toxicity.Scorer(*toxicity.fit(rows, 40))
    score = lambda t: float(scorer(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0])
    clean = " ".join(plain[:29])
    assert score(f"{clean} worthlesss") > 10 * score(f"{clean} {plain[30]}")


def test_every_language_has_a_model(spark):
    """Languages of a single row far above their share of the bytes, among many."""
    rng = random.Random(3)
    names = [f"l{k:02}" for k in range(26)]
    word = lambda k: "".join(chr(97 + (k + rng.randrange(3)) % 26) for _ in range(6))
    rows = [(k, name, " ".join(word(k) for _ in range(3000))) for k, name in enumerate(names)]
    rows += [(1000 + i, "zz", " ".join(chr(0x3B1 + rng.randrange(20)) * 2 for _ in range(4))) for i in range(400)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string"), None, 3, 12_000, 27 * 4000, "doc_id", "text", "lang")
    assert model.names == [*names, "zz"]
    for k, name in enumerate(names):
        data = np.frombuffer(rows[k][2][:300].encode(), np.uint8)
        assert model.names[model.predict(data, np.array([0, len(data)]))[0][0]] == name


def test_language_held_out(spark):
    got = held_out_rows(spark, language.op10_language, LARGER, "lang", 1, 3)
    assert (got.lang == got.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_registry_is_complete():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 11))
