"""Queries that write tables as files to the shared folder and read them back: readers, sinks and binary formats."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.functions.text import READINGS as _X
from pairlens.functions.keys import canonical_patch, clean_word, patch_number
from pairlens.operators import splits, validate
from pairlens.plans.catalogue import _CLEAN, _NUM, _cards, _rx
from pairlens.session import shared_dir
from pairlens.sources import config, sinks, tables, tiff
from pairlens.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _new(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pairlens/{name}-{uuid.uuid4().hex}"


@query("select rec_id, patch_id, candidate_class, n_triplets, has_reference, study_area from train_patches")
def q_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Records written as JSON lines with blank lines between them, and read under a declared schema."""
    path = _new(spark, "jsonl")
    t = table(spark, d, "train_patches").select("rec_id", "patch_id", "candidate_class", "n_triplets", "has_reference", "study_area")
    t.select(F.concat(F.to_json(F.struct(*t.columns)), F.lit("\n")).alias("value")).write.text(path)
    return tables.json_lines(spark, path, "rec_id long, patch_id string, candidate_class string, n_triplets int, has_reference boolean, study_area string")


@query(f"select patch, rec_id, study_area from (select {_NUM.format('patch_id')} as patch, rec_id, study_area, row_number() over (partition by {_NUM.format('patch_id')} order by rec_id desc) as k from train_patches) where k = 1 and patch is not null")
def q_keyed_records(spark: SparkSession, d: str) -> DataFrame:
    """The last record of each patch out of JSON lines."""
    path = _new(spark, "keyed")
    sinks.write_new(table(spark, d, "train_patches").select(patch_number(F.col("patch_id")).alias("patch"), "rec_id", "study_area").filter("patch is not null"), path, "json")
    return tables.keyed(tables.json_lines(spark, path, "patch long, rec_id long, study_area string"), "patch", "rec_id")


@query("select row_id, id from predictions_explain")
def q_csv_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that stay text through a CSV file, with their blanks."""
    path = _new(spark, "csv")
    t = table(spark, d, "predictions_explain").select("row_id", "id")
    t.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return tables.csv_table(spark, path, "row_id long, id string")


@query("select rec_id, study_area from test_patches order by rec_id limit 40")
def q_csv_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The first 40 records of a CSV file in the order of their ids: the reader's optional limit."""
    path = _new(spark, "prefix")
    sinks.write_new(table(spark, d, "test_patches").select("rec_id", "study_area"), path, "csv")
    return splits.ordered_prefix(tables.csv_table(spark, path, "rec_id long, study_area string"), ["rec_id"], 40)


@query("select t.study_area, count(*) as n, count(b.block_id) as known, count(*) filter (b.study_area = t.study_area) as same_area from train_patches t left join spatial_blocks b on b.block_id = t.block_id group by 1")
def q_csv_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A CSV file keyed by id, looked up by a left join."""
    path = _new(spark, "lookup")
    sinks.write_new(table(spark, d, "spatial_blocks").select("block_id", F.col("study_area").alias("block_area")), path, "csv")
    b = tables.csv_table(spark, path, "block_id int, block_area string")
    j = table(spark, d, "train_patches").select("block_id", "study_area").join(b, "block_id", "left")
    return j.groupBy("study_area").agg(F.count(F.lit(1)).alias("n"), F.count("block_area").alias("known"), F.count(F.when(F.col("block_area") == F.col("study_area"), 1)).alias("same_area"))


@query("""select combo_id, 'ok' as status, count(*) as n, count(pred) as answered, count(distinct id) as n_ids from predictions_explain group by 1 union all select 'no_such_run', 'load_failed', 0, 0, 0""")
def q_run_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports of runs as JSON, a part of at most 500 answers each, with one that failed to load; counts of what they hold."""
    path = _new(spark, "reports")
    p = table(spark, d, "predictions_explain").select("combo_id", F.struct("id", "gold", F.col("raw_text").alias("pred_text"), "pred").alias("p"), F.floor(F.col("row_id") / 500).alias("part"))
    r = p.groupBy("combo_id", "part").agg(F.collect_list("p").alias("predictions")).select("combo_id", F.lit(None).cast("string").alias("status"), "predictions")
    failed = spark.range(1).select(F.lit("no_such_run").alias("combo_id"), F.lit("load_failed").alias("status"), F.lit(None).cast("array<struct<id:string,gold:string,pred_text:string,pred:string>>").alias("predictions"))
    sinks.write_new(r.unionByName(failed), path, "json")
    got = tables.run_reports(spark, path, lines=True)
    return got.groupBy("combo_id", "status").agg(F.count(F.when(F.col("status") == "ok", 1)).alias("n"), F.count("pred").alias("answered"), F.countDistinct("id").alias("n_ids"))


@query(f"""with l as (select row_id, printf('p%05d', {_NUM.format('id')} % 100000) as id from predictions_explain where row_id > 1000), f as (select id, min(row_id) as first_row from l group by 1)
select id, row_number() over (order by first_row) as place from f""")
def q_log_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that a log names after its marker, numbered in the order of their first mention."""
    from pyspark.sql import Window

    path = _new(spark, "log")
    p = table(spark, d, "predictions_explain").select("row_id", F.pmod(patch_number(F.col("id")), F.lit(100000)).alias("n"))
    lines = p.select("row_id", F.when(F.col("n").isNull(), "no id here").otherwise(F.format_string("[%d/9] p%05d", "row_id", "n")).alias("value"))
    marker = spark.range(1).select(F.lit(1000.5).alias("row_id"), F.lit("batch two begins").alias("value"))
    # A log is one stream: its order is that of one file.
    lines.select(F.col("row_id").cast("double").alias("row_id"), "value").unionByName(marker).coalesce(1).sortWithinPartitions("row_id").select("value").write.text(path)
    ids = tables.logged_ids(spark, path, "batch two begins")
    return ids.withColumn("place", F.row_number().over(Window.orderBy("first_line"))).select("id", "place")  # one row per id


@query("select doc_id::varchar as path, octet_length(encode(text)) as length, sha256(text) as sha256 from documents where text is not null")
def q_checksums(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of contents."""
    f = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.octet_length("text").cast("long").alias("length"), F.encode("text", "UTF-8").alias("content"))
    return tables.checksums(f)


_NPY = b"\x93NUMPY\x01\x00v\x00" + b"{'descr': '<f4', 'fortran_order': False, 'shape': (8, 8), }".ljust(117) + b"\n"


def _npy_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        whole = [_NPY + np.asarray(v, "<f4").tobytes() for v in p["embedding"]]
        yield pd.DataFrame({"path": p["path"], "content": [b"" if int(k) % 10 == 0 else c for k, c in zip(p["path"], whole)]})


@query("select vec_id::varchar as path, case when vec_id % 10 <> 0 then [8, 8]::int[] end as shape, case when vec_id % 10 <> 0 then round(list_sum(embedding::double[]), 5) end as total from embeddings")
def q_tensors(spark: SparkSession, d: str) -> DataFrame:
    """Arrays out of ``.npy`` files; every tenth can't be read."""
    f = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), "embedding").mapInPandas(_npy_files, "path string, content binary")
    return tables.tensors(f).select("path", "shape", F.round(F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def _tiff_files(bands: int):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for v in p["embedding"]:
                a = np.asarray(v, "<f4")[: 16 * bands].copy()
                a[0] = -9999
                tags = [(256, 3, 1, 4), (257, 3, 1, 4), (258, 3, 1, 32), (259, 3, 1, 1), (273, 4, 1, 8 + 2 + 12 * 10 + 4), (277, 3, 1, bands), (278, 3, 1, 4), (279, 4, 1, a.nbytes), (339, 3, 1, 3), (42113, 2, 6, 8 + 2 + 12 * 10 + 4 + a.nbytes)]
                fields = b"".join(struct.pack("<HHI", *t[:3]) + (struct.pack("<HH", t[3], 0) if t[1] == 3 else struct.pack("<I", t[3])) for t in tags)
                out.append(struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(tags)) + fields + struct.pack("<I", 0) + a.tobytes() + b"-9999\0")
            yield pd.DataFrame({"path": p["path"], "content": out})

    return run


def _rasters(spark: SparkSession, d: str, bands: int) -> DataFrame:
    f = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), "embedding").mapInPandas(_tiff_files(bands), "path string, content binary")
    return tiff.rasters(f)


_seen = lambda px: F.filter(px, lambda x: ~F.isnan(x))
_total = lambda px: F.round(F.aggregate(_seen(px), F.lit(0.0), lambda a, x: a + x.cast("double")), 5)


@query("select vec_id::varchar as path, 4 as height, 4 as width, 1 as bands, 15 as n, round(list_sum(embedding[2:16]::double[]), 5) as total from embeddings")
def q_raster_band(spark: SparkSession, d: str) -> DataFrame:
    """Rasters of one band, their nodata value as NaN."""
    return _rasters(spark, d, 1).select("path", "height", "width", "bands", F.size(_seen(F.col("pixels"))).alias("n"), _total(F.col("pixels")).alias("total"))


@query("select vec_id::varchar as path, 3 as bands, 48 as n, 45 as seen, round(3 * list_sum(embedding[2:16]::double[]), 4) as total from embeddings")
def q_raster_rgb(spark: SparkSession, d: str) -> DataFrame:
    """Rasters of one band shown as three."""
    r = tiff.as_rgb(_rasters(spark, d, 1))
    return r.select("path", "bands", F.size("pixels").alias("n"), F.size(_seen(F.col("pixels"))).alias("seen"), F.round(F.aggregate(_seen(F.col("pixels")), F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("select vec_id::varchar as path, 4 as bands, 63 as n, round(list_sum([embedding[i]::double for i in range(6, 65, 4)]), 5) as second_band from embeddings")
def q_raster_bands(spark: SparkSession, d: str) -> DataFrame:
    """Rasters of four bands, pixel by pixel."""
    r = _rasters(spark, d, 4)
    second = F.filter(F.col("pixels"), lambda x, i: (i % 4 == 1) & (i > 4))
    return r.select("path", "bands", F.size(_seen(F.col("pixels"))).alias("n"), F.round(F.aggregate(second, F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("second_band"))


_LAYER_SQL = ", ".join(f"({i}, '{s}')" for i, s in enumerate(validate.LAYERS))


@query(f"""with p as (select distinct {_NUM.format('patch_id')} as n from train_patches), l(i, s) as (values {_LAYER_SQL}), h as (select n, list_sort(list(s)) as layers from p, l where (n + i * i) % 11 <> 0 and n is not null group by 1)
select printf('p%09d', n) as scene_id, len(layers) as n_layers, 15 - len(layers) as n_missing, len(layers) = 15 as complete, list_has_all(layers, ['_T0_rgb', '_T1_rgb', '_delta_ndvi', '_delta_nbr']) as usable from h""")
def q_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Scenes out of a listing of files: layers, what is missing, whether a scene is complete or usable."""
    p = table(spark, d, "train_patches").select(patch_number(F.col("patch_id")).alias("n")).filter("n is not null").distinct()
    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(validate.LAYERS)])
    files = p.select("n", F.explode(names).alias("l")).filter((F.col("n") + F.col("l.i") * F.col("l.i")) % 11 != 0)
    g = validate.scenes_of(files.select(F.concat(F.lit("/data/"), canonical_patch(F.col("n")), F.col("l.s"), F.lit(".tif")).alias("path")))
    return g.select("scene_id", F.size("layers").alias("n_layers"), F.size("missing").alias("n_missing"), "complete", "usable")


@query("select * from (select 1 as written, * from (select study_area, count(*) as n from dev_patches group by 1) union all select 2, * from (select study_area, count(*) as n from test_patches group by 1))")
def q_no_clobber(spark: SparkSession, d: str) -> DataFrame:
    """Two tables written to one place: the second goes to a sibling, and both are there."""
    path = _new(spark, "sink")
    counts = lambda name: table(spark, d, name).groupBy("study_area").agg(F.count(F.lit(1)).alias("n"))
    first, second = sinks.write_new(counts("dev_patches"), path), sinks.write_new(counts("test_patches"), path)
    read = lambda p, k: spark.read.parquet(p).select(F.lit(k).alias("written"), "study_area", "n")
    return read(first, 1).unionByName(read(second, 2))


@query("""with a as (select 'dev' as split, rec_id from dev_patches union all select 'test', rec_id from test_patches union all select 'train', rec_id from train_patches)
select split, count(*) as n, count(*) as n_read, min(rec_id) as first, max(rec_id) as last from a group by 1""")
def q_split_files(spark: SparkSession, d: str) -> DataFrame:
    """One folder of CSV for each split, with the manifest of what was written and what is read back."""
    parts = [table(spark, d, f"{s}_patches").select(F.lit(s).alias("split"), "rec_id", "study_area") for s in ("train", "dev", "test")]
    path, manifest = sinks.write_splits(parts[0].unionByName(parts[1]).unionByName(parts[2]), _new(spark, "splits"), "rec_id")
    got = spark.read.schema("rec_id long, study_area string, split string").option("header", True).csv(path)
    return manifest.join(got.groupBy("split").agg(F.count(F.lit(1)).alias("n_read"), F.min("rec_id").alias("first"), F.max("rec_id").alias("last")), "split")


@query(f"select row_id, gold, {_rx(_X['NDVI'][0])} as ndvi, {_rx(_X['rain_t1'][0])} as rain from predictions_explain")
def q_card_files(spark: SparkSession, d: str) -> DataFrame:
    """Evidence cards as JSON objects with nested readings, written and read back."""
    path = _new(spark, "cards")
    sinks.write_new(_cards(spark, d).select("row_id", "gold", F.struct(F.col("NDVI").alias("ndvi"), F.struct(F.col("rain_t1").alias("t1")).alias("rain")).alias("readings")), path, "json")
    return tables.json_lines(spark, path, "row_id long, gold string, readings struct<ndvi:double,rain:struct<t1:double>>").select("row_id", "gold", F.col("readings.ndvi").alias("ndvi"), F.col("readings.rain.t1").alias("rain"))


_COUNTS = f"with c as (select coalesce({_CLEAN.format('candidate_class')}, 'none') as k, count(*) as n from dev_patches group by 1)"


@query(
    _COUNTS
    + """ select 'latex' as kind, concat('\\begin{tabular}{ll}', chr(10), 'class & n \\\\', chr(10), string_agg(concat(replace(k, '_', '\\_'), ' & ', n), concat(' \\\\', chr(10)) order by k), ' \\\\', chr(10), '\\end{tabular}') as body from c
union all select 'markdown', concat('| class | n |', chr(10), '| --- | --- |', chr(10), string_agg(concat('| ', k, ' | ', n, ' |'), chr(10) order by k)) from c"""
)
def q_report_tables(spark: SparkSession, d: str) -> DataFrame:
    """A small table as Markdown and as LaTeX."""
    c = table(spark, d, "dev_patches").groupBy(F.coalesce(clean_word(F.col("candidate_class")), F.lit("none")).alias("class")).agg(F.count(F.lit(1)).alias("n")).orderBy("class")
    return spark.createDataFrame([("markdown", sinks.markdown_table(c)), ("latex", sinks.latex_table(c))], "kind string, body string")


@query("select concat('Rows: ', (select count(*) from train_patches), ' and ', (select count(*) from dev_patches), '; «OTHER» stays.') as body, ['OTHER'] as left_over")
def q_placeholders(spark: SparkSession, d: str) -> DataFrame:
    """A text whose placeholders are filled from metrics; unknown ones stay and are listed."""
    n = {k: table(spark, d, f"{k.lower()}_patches").count() for k in ("TRAIN", "DEV")}
    body, rest = sinks.fill_placeholders("Rows: «TRAIN» and «DEV»; «OTHER» stays.", n)
    return spark.createDataFrame([(body, rest)], "body string, left_over array<string>")


@query("select * from (values ('classes', 'decline,stable'), ('climatology', '2015-01-01,2022-01-01'), ('patch_pixels', '32'), ('pixel_m', '10.0'), ('t0', '2022-01-01,2022-03-01'), ('t1', '2023-01-01,2023-03-01')) t(name, value)")
def q_study_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings of a study with two of them given."""
    s = config.Study().merged({"patch_pixels": 32, "classes": ["decline", "stable"]})
    text = lambda v: ",".join(v) if isinstance(v, tuple) else str(v)
    return spark.createDataFrame([(k, text(v)) for k, v in vars(s).items()], "name string, value string")
