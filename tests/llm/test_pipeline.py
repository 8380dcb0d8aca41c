"""The stages one after another, each against what it must do to its own input."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from slotwise.llm import library_tokens
from slotwise.llm.defaults import BYTE_TOKENIZER
from slotwise.sources.staging import stage
from tests.llm.test_pii import base
from tests.llm.test_quality import base as base_counts
from tests.llm.test_simhash import want_groups
from tests.llm.test_tokens import check_packing


def test_registered():
    names = [n for n in queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert queries()["pipeline"].__wrapped__ is corpus_pipeline.run and "pipeline" not in oracle_sql()


def test_stages(spark, sf_dir, docs):
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    before = docs
    results = []
    for name, apply in corpus_pipeline.STAGES:
        after = stage(apply(spark, before, sf_dir), "test-stage")
        if name != "packing":
            assert after.dtypes == docs.dtypes
        results.append((before.collect(), after.collect()))
        before = after
    rows, kept = results[0]
    texts = {r.doc_id: r.text for r in rows}
    assert all(not base_counts(r.text)[1] for r in kept)
    left = {r.doc_id for r in kept}
    clean = {d for d in good if d in texts and not base_counts(texts[d])[1]}
    assert len(clean & left) >= 0.95 * len(clean)
    rows, kept = results[1]
    gone = {r.doc_id for r in rows} - {r.doc_id for r in kept}
    assert {r.doc_id for r in rows} >= {r.doc_id for r in kept}
    assert len(gone & good) <= 0.1 * max(1, len({r.doc_id for r in rows} & good))
    rows, kept = results[2]
    assert sorted(r.doc_id for r in kept) == sorted(set(want_groups([(r.doc_id, r.text) for r in rows])))
    rows, kept = results[3]
    assert len(rows) == len(kept)
    assert not any(base(r.text) for r in kept) and all(r.n_chars == len(r.text) for r in kept)
    rows, pieces = results[4]
    texts, encode = {r.doc_id: r.text for r in rows}, library_tokens.library_tokens(BYTE_TOKENIZER, True).encode_texts
    assert {r.doc_id for r in pieces} == set(texts)
    assert check_packing(pieces, lambda d: [*encode([texts[d]])[0].tolist(), 0], 1024) < 0.02


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_input_passes_every_stage(spark, edge_docs, no_docs, tmp_path, empty):
    frame = no_docs if empty else edge_docs
    # Names that operators use for their own columns.
    for i, name in enumerate(("q_kept", "Q_n_words", "t_score", "p_spans", "__row", "__fingerprint", "fingerprint", "row", "others",
                              "label", "quality", "toxic", "stays", "first", "kept", "c0")):
        frame = frame.withColumn(name, F.lit(i))
    labels = pa.table({"doc_id": pa.array([0, 1, None], pa.int64()), "quality": pa.array([1, 0, 1], pa.int32()),
                       "toxic": pa.array([0, 1, None], pa.int32())})
    spark.createDataFrame(labels).write.parquet(f"{tmp_path}/labels.parquet")
    for name, apply in corpus_pipeline.STAGES:
        after = stage(apply(spark, frame, str(tmp_path)), "test-awkward")
        assert name == "packing" or after.dtypes == frame.dtypes
        assert name == "packing" or after.where("t_score <> 2 or c0 <> 15 or __row <> 4").count() == 0
        frame = after
