"""The pipeline's stages against brute force, each on what the one before it kept."""

import sys
from pathlib import Path

import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline
from test_ops import AWKWARD, DOCS, classes_by_hand, dedup_by_hand, scan_by_hand

from tessera.llm import quality_crf, textvec
from tessera.llm.labelled import sample_frame

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def sample(*args):
    """The rows that a classifier is fitted on, in a fixed order."""
    return [(r["text"], r["label"]) for r in sorted(sample_frame(*args).collect(), key=lambda r: (r["doc_id"], r["label"], r["text"]))]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, stages = zip(*corpus_pipeline.STAGES)
    assert names == ("quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing")
    found = [stages[0](spark, docs, SF).cache()]
    for stage in stages[1:]:
        found.append(stage(spark, found[-1], SF).cache())
    assert all(f.columns == docs.columns for f in found[:4])

    field = quality_crf.LineField.fit(sample(docs, spark.read.parquet(f"{SF}/labels.parquet"), "quality", quality_crf.FOLDS, quality_crf.FOLD))
    score = lambda t: next(field.scores(d, o)[0] for _, d, o in textvec.blocks(pa.array([t])))
    good = [(i, t) for i, t in rows(docs) if score(t) >= 0.5]
    assert rows(found[0]) == good
    dedup = [(i, t) for i, _, gone, t in dedup_by_hand(good, 40, 5) if not gone or t.strip()]
    assert rows(found[1]) == dedup
    near = {i for i, _, c in classes_by_hand(dedup) if i == c}
    assert rows(found[2]) == [(i, t) for i, t in dedup if i in near]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {i for i, _, hit, _ in scan_by_hand(rows(found[2]), items) if not hit}
    assert rows(found[3]) == [(i, t) for i, t in rows(found[2]) if i in clean]
    mixed = {r["doc_id"]: r for r in found[4].collect()}
    assert set(mixed) == clean
    targets = {r["source"]: r["target"] for r in mixed.values()}
    for source, target in targets.items():
        assert sum(r["taken"] for r in mixed.values() if r["source"] == source) == int(round(target, 6))
    again = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert again == mixed


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_awkward_tables(spark, stage):
    df = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in AWKWARD], DOCS)
    run = corpus_pipeline.STAGES[stage][1]
    assert run(spark, df.limit(0), SF).count() == 0
    out = run(spark, df, SF)
    if stage == 2:
        # The repeated row of document 5 stays once.
        assert sorted((r["doc_id"] for r in out.collect()), key=repr) == sorted([1, 2, 3, 4, 5, 6, None], key=repr)
    elif stage in (1, 3, 4):
        assert out.count() == 8
    if stage < 4:
        assert out.columns == df.columns
        names = ["row", "n", "sig", "key", "root", "component_id", "place", "__lines", "__id", "__key", "__text", "__found", "__hits", "__index", "__doc", "__row", "__drop", "__all"]
        extra = df.selectExpr("*", *[f"'{k}' as `{name}`" for k, name in enumerate(names)])
        kept = run(spark, extra, SF)
        assert kept.columns == extra.columns and {tuple(r)[5:] for r in kept.collect()} == {tuple(map(str, range(len(names))))}
        assert kept.count() == out.count()


def test_near_duplicates_of_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(60))
    third = " ".join(f"u{k}" for k in range(60))
    rows = [(3, text), (5, other), (5, text + " tail"), (5, third), (5, third), (9, third + " more"), (5, ""), (9, ""), (None, other + " end"), (9, other)]
    df = spark.createDataFrame([(i, t, "en", "a", None) for i, t in rows], DOCS)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()]
    # The row without id stands under a negative number, which is the smallest of its class.
    assert sorted(kept, key=repr) == sorted([(3, text), (5, third), (5, ""), (9, ""), (None, other + " end")], key=repr)
