"""Each stage of the pipeline against a plain version on its own input."""

import os
from urllib.parse import urlparse

import corpus_pipeline as pipeline
import pandas as pd
import pytest
from lodegraph.llm import jaccard, packing, shared, toxicity

from . import brute


@pytest.fixture(scope="module")
def outputs(spark, sf, tmp_path_factory):
    where = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, step in pipeline.STAGES:
        step(spark, docs, sf).write.parquet(str(where / name))
        docs = spark.read.parquet(str(where / name))
        out.append(docs.toPandas())
    return out


def test_columns(outputs, small):
    assert all(list(o.columns) == list(small.columns) for o in outputs[:-1])


def test_toxic_go(spark, sf, outputs, small):
    scored = toxicity.op6_toxicity(spark, sf).toPandas()
    assert sorted(outputs[0].doc_id) == sorted(scored[scored.score < 0.5].doc_id)


def test_one_of_linked_stays(outputs):
    before = outputs[0]
    _, component = brute.components(before.doc_id.tolist(), before.text.tolist(), 80, 5)
    assert sorted(outputs[1].doc_id) == sorted(set(component))


def test_linked_near_the_threshold(spark, sf):
    """Five-word shingles: a changed word in the middle of n breaks five of n - 4."""
    base = [f"w{k}" for k in range(100)]
    changed = lambda *at: " ".join("x" + w if k in at else w for k, w in enumerate(base))
    rows = [(1, changed()), (2, changed(10, 50)), (3, changed(30, 60, 90)), (4, " ".join(base[:4]))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    # 86 of 106 shingles in common with 2, 81 of 111 with 3
    assert sorted(r["doc_id"] for r in pipeline.keep_one_of_linked(spark, docs, sf).collect()) == [1, 3, 4]


def test_repeats_are_cut(outputs):
    before = outputs[1]
    masks = brute.removed(before.doc_id.tolist(), before.text.tolist())
    want = {d: brute.kept(t, m).decode("utf-8", "ignore") for d, t, m in zip(before.doc_id, before.text, masks) if not t or not all(m)}
    after = outputs[2]
    assert dict(zip(after.doc_id, after.text)) == want and after.n_chars.tolist() == after.text.str.len().tolist()


def test_contaminated_go(outputs, sf):
    items = list(pd.read_parquet(f"{sf}/benchmark.parquet").itertuples(index=False, name=None))
    want = [d for d, t in zip(outputs[2].doc_id, outputs[2].text) if not brute.contamination(t, items)[1]]
    assert sorted(outputs[3].doc_id) == sorted(want)


def test_all_is_packed(outputs):
    packed = outputs[4]
    assert set(packed.doc_id) == set(outputs[3].doc_id)
    assert packed.groupby("sequence_id").length.sum().max() <= packing.CAPACITY


def test_run(spark, sf, outputs):
    assert pipeline.run(spark, sf).count() == len(outputs[4])


@pytest.mark.parametrize("toxic", [None, [1, 1, 0]])
def test_what_toxicity_cannot_judge_stays(spark, edge, tmp_path, toxic):
    """No labels at all; more toxic labels than clean ones, a bias above 0."""
    docs = edge.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) as n_chars")
    rows = [] if toxic is None else list(zip((1, 4, 8), (1, 1, 1), toxic))
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = [r["doc_id"] for r in pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()]
    assert {2, 3, 5, 9} <= set(kept) and (toxic is not None or len(kept) == docs.count())


def test_null_and_empty_texts_pass(spark, edge, sf):
    docs = edge.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) as n_chars", "score")
    for _, step in pipeline.STAGES[:-1]:
        docs = step(spark, docs, sf)
        rows = docs.collect()
        assert {2, 3} <= {r["doc_id"] for r in rows} and any(r["doc_id"] is None for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    assert pipeline.STAGES[-1][1](spark, docs, sf).count() > 0


def run_stages(spark, docs, sf):
    out = []
    for _, step in pipeline.STAGES:
        made = step(spark, docs, sf)
        rows = made.collect()
        out.append(rows)
        docs = spark.createDataFrame(rows, made.schema)
    return out


def test_empty_table(spark, small, sf):
    docs = spark.createDataFrame(small).limit(0)
    assert [len(rows) for rows in run_stages(spark, docs, sf)] == [0] * 5


def test_repeated_rows_and_ties(spark, small, sf):
    """Rows of one id stay together; of copies under several ids the smallest stays."""
    some = small.head(12)
    copies = some.assign(doc_id=some.doc_id + 10_000)
    docs = spark.createDataFrame(pd.concat([some, some.head(3), copies]))
    out = run_stages(spark, docs, sf)
    kept = [sorted(r["doc_id"] for r in rows) for rows in out[:4]]
    first = set(some.doc_id.head(3))
    assert all((ids.count(d) in (0, 2)) == (d in first) or ids.count(d) in (0, 1) for ids in kept for d in ids)
    assert max(kept[1]) < 10_000 and set(kept[1]) <= set(kept[0])
    packed = [r for r in out[4] if r["piece"] == 0]
    assert sorted(r["doc_id"] for r in packed) == kept[3]
    assert max(pd.DataFrame([r.asDict() for r in out[4]]).groupby("sequence_id").length.sum()) <= packing.CAPACITY


def test_stages_leave_little_on_disk(spark, small):
    """Texts are staged once for the cutting; of the join only tables of ids are left."""
    frame = spark.createDataFrame(small)
    begun = set(os.listdir(root := urlparse(shared.folder(spark)).path))
    links = jaccard.link_components(frame)
    assert len(os.listdir(f"{root}/{(set(os.listdir(root)) - begun).pop()}")) <= 4
    assert links.count() == len(small)
    begun = set(os.listdir(root))
    cut = pipeline.cut_repeats(spark, frame, "")
    made = spark.read.parquet(f"{root}/{(set(os.listdir(root)) - begun).pop()}/texts")
    assert "text" in made.columns and "text" not in made.schema["carried"].dataType.names
    assert cut.where("text is null").count() == small.text.isna().sum()
