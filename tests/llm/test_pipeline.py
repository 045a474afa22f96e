"""The pipeline, stage by stage, against plain Python."""

import corpus_pipeline
from spotloom.llm import secrets, toxicity
from spotloom.llm.frames import crc_remainder, table

from .test_operators import brute_components, brute_overlaps


def test_pipeline_equals_its_stages_by_brute_force(spark, sf_dir):
    from pyspark.sql import functions as F

    from spotloom.llm.frames import crc_mod

    docs = table(spark, sf_dir, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    labels = table(spark, sf_dir, "labels")
    assert all(r.m == crc_remainder(r.doc_id, 4) for r in docs.select("doc_id", crc_mod(F.col("doc_id"), 4).alias("m")).collect())
    model = toxicity.fit(docs, labels.where(crc_mod(F.col("doc_id"), 4) != 2))
    toxic = {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.3").collect()}
    kept = {i: t for i, t in rows.items() if i not in toxic}
    kept = {i: kept[i] for i, (_, c) in brute_components(list(kept.items()), 5, 80).items() if c == i}
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    kept = {i: kept[i] for i, _, n, _ in brute_overlaps(list(kept.items()), items) if not n}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(kept)
    lengths = {}
    for r in got:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    from spotloom.llm.registry import tokenizer_path
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(tokenizer_path())
    assert lengths == {i: len(enc.encode(secrets.redact(t, secrets.find(t)) or "", add_special_tokens=False).ids) + 1 for i, t in kept.items()}


def test_stages_keep_columns_and_odd_rows(spark, sf_dir, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == list(corpus_pipeline.COLUMNS), name
            assert out.count() <= docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count()


def test_a_run_leaves_its_result_alone(spark, sf_dir, monkeypatch, tmp_path):
    from spotloom.llm import frames

    def forbidden(*_, **__):
        raise AssertionError("no machine-local folder")

    monkeypatch.setattr(frames.tempfile, "mkdtemp", forbidden)
    monkeypatch.setattr(frames, "shared_folder", lambda _: str(tmp_path))
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = corpus_pipeline.run(spark, sf_dir)
    assert [p.name for p in tmp_path.glob("spotloom-*/*")] == ["4-packing"] and len(list(tmp_path.glob("spotloom-*"))) == 1 and out.count() > 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == rows


def test_a_cluster_without_a_shared_folder_is_an_error():
    import types

    import pytest

    from spotloom.llm import frames

    fake = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(master="local-cluster[2,1,1000]"))
    with pytest.raises(ValueError):
        frames.shared_folder(fake)
