"""The pipeline on the smallest table: columns, decisions, and stages by plain versions."""

from pathlib import Path

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")
def test_stages(spark, tmp_path):
    from tests.llm.test_decontamination import brute as leaks
    from tests.llm.test_jaccard_join import brute as components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "jaccard_join", "decontamination", "packing"]
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = str(tmp_path / name)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        was, now = [(r["doc_id"], r["text"]) for r in docs.collect()], out.collect()
        ids = {r["doc_id"] for r in now}
        if name == "packing":
            assert ids == {d for d, _ in was}
            break
        assert out.columns == columns
        if name == "quality_classifier":
            assert not ids & bad and len(ids) > 0.8 * (len(was) - len(bad))
        elif name == "line_dedup":
            assert ids == {d for d, _ in was} and all(len(r["text"]) == r["n_chars"] for r in now)
        elif name == "jaccard_join":
            assert ids == {c for _, _, c in components(was)}
        else:
            assert ids == {d for d, _ in was} - {d for d, _ in leaks(was, benchmark)}
        docs = out
