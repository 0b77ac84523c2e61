from __future__ import annotations

from tidewell.catalog import fixtures as fx


def test_texts_are_dealt_by_stored_size(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i} " + "ab cde" * (i % 5), "en", "s") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 3, [1.0])], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert fx.table(spark, str(tmp_path), "documents").rdd.getNumPartitions() == cores
    monkeypatch.setattr(fx, "PART_BYTES", 64)
    parts = fx.text_parts(spark, f"{tmp_path}/documents.parquet")
    assert parts > cores
    assert fx.table(spark, str(tmp_path), "documents").rdd.getNumPartitions() == parts
    assert sorted(r["chunk_id"] for r in fx.chunks(spark, str(tmp_path)).collect()) == list(range(300))
