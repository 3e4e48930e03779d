from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from pairlens.sources import sinks
from pairlens.sources import tables as T
from pairlens.streaming.events import windowed_counts
from tests.conftest import SMALL, rows


def test_json_csv_and_keys(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "a", "n": 1}\n\n{"id": "a", "n": 2}\n{"id": "b", "n": null}\n')
    df = T.json_lines(spark, str(p), "id string, n int")
    assert df.filter("id is not null").count() == 3
    assert rows(T.keyed(df.filter("n is not null"), "id", "n")) == [("a", 2)]
    c = tmp_path / "a.csv"
    c.write_text("patch_id,x\n00012,1.5\n")
    assert T.csv_table(spark, str(c), "patch_id string, x double").first().patch_id == "00012"


def test_run_reports(spark, tmp_path):
    (tmp_path / "r1.json").write_text(json.dumps({"combo_id": "a", "status": "ok", "predictions": [{"id": "1", "gold": "stable", "pred": None}]}, indent=1))
    (tmp_path / "r2.json").write_text(json.dumps({"combo_id": "b", "status": "load_failed"}, indent=1))
    got = {r.combo_id: (r.status, r.id) for r in T.run_reports(spark, str(tmp_path)).collect()}
    assert got == {"a": ("ok", "1"), "b": ("load_failed", None)}
    runs = spark.createDataFrame([("a", None, "f1"), ("a", "structured", "f2"), ("b", None, "f3")], "combo_id string, prompt_style string, file string")
    assert sorted(r.file for r in T.preferred_reports(runs).collect()) == ["f2", "f3"]


def test_log_and_files(spark, tmp_path):
    p = tmp_path / "log.txt"
    p.write_text("[1/72] p00001\nBATCH 300:372\n[1/72] p00002\n[2/72] p00003\n[2/72] p00002\n")
    assert [(r.id, r.first_line) for r in T.logged_ids(spark, str(p), "BATCH 300:372").orderBy("first_line").collect()] == [("p00002", 2), ("p00003", 3)]
    np.save(tmp_path / "t.npy", np.arange(6.0).reshape(2, 3))
    (tmp_path / "bad.npy").write_bytes(b"no")
    f = T.binary_files(spark, str(tmp_path), "*.npy")
    got = {r.path.rsplit("/", 1)[1]: (r.shape, r.pixels) for r in T.tensors(f).collect()}
    assert got == {"t.npy": ([2, 3], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]), "bad.npy": (None, None)}
    assert all(len(r.sha256) == 64 for r in T.checksums(f).collect())


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "train"), ("a", "train"), ("c", "test")], "id string, split string")
    first = sinks.write_new(df, str(tmp_path / "x"))
    second = sinks.write_new(df, str(tmp_path / "x"))
    assert first != second and spark.read.parquet(second).count() == 3
    path, manifest = sinks.write_splits(df, str(tmp_path / "s"), "id")
    assert rows(manifest) == [("test", 1), ("train", 2)]
    assert sinks.markdown_table(df.orderBy("id").limit(1)) == "| id | split |\n| --- | --- |\n| a | train |"
    assert "a & train" in sinks.latex_table(df.filter("id = 'a'"))
    assert sinks.fill_placeholders("«A» «B»", {"A": 1}) == ("1 «B»", ["B"])


def test_stream_equals_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{SMALL}/events.parquet")
    ev.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = windowed_counts(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted((r.start, r.event_type, r.n, round(r.total, 6)) for r in d.collect())
    assert key(spark.table("counts")) == key(windowed_counts(ev))
    assert windowed_counts(ev).agg(F.sum("n")).first()[0] == ev.count()


def test_required_ids_and_registry(spark):
    import pytest

    df = spark.createDataFrame([("a", "m1"), ("b", "m2")], "combo_id string, checkpoint string")
    assert T.require_all(df, df.filter("combo_id = 'a'"), "combo_id").count() == 1
    with pytest.raises(LookupError, match="1 ids"):
        T.require_all(df, spark.createDataFrame([("z",), ("a",)], "combo_id string"), "combo_id")
    own = spark.createDataFrame([("b", "mine")], "combo_id string, checkpoint string")
    assert rows(T.resolved_models(df, own)) == [("a", "m1"), ("b", "mine")]


def test_short_texts_and_unique_share(spark):
    from pairlens.functions.text import shortened
    from pairlens.operators.metrics import unique_share

    df = spark.createDataFrame([("a", "one two three"), ("a", "one"), ("a", "one"), ("b", None)], "k string, t string")
    assert [r[0] for r in df.select(shortened(F.col("t"), 9)).collect()] == ["one two …", "one", "one", None]
    assert sorted((r.k, r.n_unique, r.n, r.share) for r in unique_share(df, "t", ["k"]).collect()) == [("a", 2, 3, 2 / 3), ("b", 0, 0, None)]
