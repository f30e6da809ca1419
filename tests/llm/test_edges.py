"""Every operator over nulls, empty and long texts, repeats and clashing columns."""

import hashlib

import pytest
from lodegraph.llm import decontaminate, fingerprint, jaccard, language, lm_score, packing, quality, suffix_dedup, tokens, toxicity

from . import brute
from .conftest import LONG, ROWS

ITEMS = [(1, "quick brown fox"), (1, "quick brown fox"), (2, None), (None, "lazy dog"), (3, ""), (4, "two"), (5, "的")]


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def operators(labels, items):
    return {
        "fingerprint": lambda d: fingerprint.fingerprint(d),
        "edited": lambda d: fingerprint.compare_edited(d),
        "lm": lambda d: lm_score.score(d),
        "jaccard": lambda d: jaccard.link_components(d),
        "decontaminate": lambda d: decontaminate.decontaminate(d, items),
        "tokens": lambda d: tokens.count_tokens(d),
        "toxicity": lambda d: toxicity.score_toxicity(d, labels),
        "suffix": lambda d: suffix_dedup.remove_repeats(d),
        "quality": lambda d: quality.score_quality(d, labels),
        "packing": lambda d: packing.pack(d),
        "language": lambda d: language.identify(d),
    }


NAMES = ["fingerprint", "edited", "lm", "jaccard", "decontaminate", "tokens", "toxicity", "suffix", "quality", "packing", "language"]


@pytest.mark.parametrize("name", NAMES)
def test_row_for_each_document(edge, labels, items, name):
    got = operators(labels, items)[name](edge).collect()
    if name == "packing":
        got = [r for r in got if r["piece"] == 0]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((d is None, d or 0) for d, _ in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(edge, labels, items, name):
    assert operators(labels, items)[name](edge.limit(0)).collect() == []
    if name in ("toxicity", "quality"):
        assert len(operators(labels.limit(0), items)[name](edge).collect()) == len(ROWS)


def test_defined_results(edge, labels, items):
    by = lambda frame: {r["doc_id"]: r for r in frame.collect()}
    t = by(tokens.count_tokens(edge))
    assert (t[2]["n_tokens"], t[3]["n_tokens"], t[2]["n_bytes"]) == (0, 0, 0)
    j = by(jaccard.link_components(edge))
    assert [j[k]["component_id"] for k in (1, 2, 3, 4, 5, 10, 11)] == [1, 2, 3, 1, 5, 10, 10]
    assert j[2]["n_shingles"] == j[5]["n_shingles"] == 0 and j[10]["n_shingles"] == 1
    s = by(suffix_dedup.remove_repeats(edge))
    assert s[4]["n_removed"] == len(ROWS[0][1]) and s[1]["n_removed"] == s[2]["n_removed"] == 0
    assert s[8]["n_bytes"] == len(LONG) and s[8]["n_removed"] == 0
    d = by(decontaminate.decontaminate(edge, items))
    assert d[1]["items"] == [1] and d[1]["n_hit"] == 9 and d[10]["items"] == [4] and d[2]["n_words"] == 0
    assert [tuple(x) for x in d[10]["spans"]] == [(4, 7)]
    lang = by(language.identify(edge))
    assert lang[2]["lang_pred"] == lang[9]["lang_pred"] == "und" and lang[1]["lang_pred"] == "en"
    f = [r["fingerprint"] for r in fingerprint.fingerprint(edge).collect()]
    assert f[0] == f[3] == f[4] and f[1] == f[2]
    p = packing.pack(edge).collect()
    assert [(r["start"], r["length"]) for r in p if r["doc_id"] == 2] == [(0, 1)]


def test_edited_texts(edge):
    got = fingerprint.compare_edited(edge).collect()
    rows = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, (r[1] or "").encode()))
    values = [t or "" for _, t in rows]
    want = sorted(hashlib.sha256((a[: len(a) - len(a) // 3] + b[: len(a) // 3]).encode()).hexdigest() for a, b in zip(values, values[1:] + values[:1]))
    assert sorted(r["edited_sha256"] for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_suffix_against_brute_force(edge):
    ids, values = [d for d, _ in ROWS], [t for _, t in ROWS]
    masks = brute.removed(ids, values)
    want = sorted((d is None, d or 0, sum(m), brute.spans(m), brute.sha(brute.kept(t, m))) for d, t, m in zip(ids, values, masks))
    got = suffix_dedup.remove_repeats(edge).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"], len(r["spans"]), brute.sha(bytes(r["kept"]))) for r in got) == want
