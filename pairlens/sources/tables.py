"""Readers and writers of tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a folder of parquet tables."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a file of JSON lines under a declared schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def keyed(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last one by ``order``."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header under a declared schema, so ids stay text."""
    return spark.read.schema(schema).option("header", True).csv(path)


def run_reports(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(``file``, ``combo_id``, ``status``, ``id``, ``gold``, ``pred_text``, ``pred``) of JSON reports of runs, one a file or (``lines``) one a line; a run without
    predictions keeps one row."""
    from pyspark.sql import functions as F

    schema = "combo_id string, status string, predictions array<struct<id:string,gold:string,pred_text:string,pred:string>>"
    r = spark.read.schema(schema).option("multiLine", not lines).json(path).withColumn("file", F.input_file_name())
    return r.select("file", "combo_id", F.coalesce("status", F.lit("ok")).alias("status"), F.explode_outer("predictions").alias("p")).select("file", "combo_id", "status", "p.*")


def preferred_reports(runs: DataFrame) -> DataFrame:
    """One report of each ``combo_id``: a structured one before others, then by ``file``. ``runs`` needs ``prompt_style`` (null: legacy)."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    style = F.coalesce("prompt_style", F.lit("legacy"))
    w = Window.partitionBy("combo_id").orderBy((style != "structured").cast("int"), "file")
    return runs.withColumn("prompt_style", style).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def logged_ids(spark: SparkSession, path: str, marker: str, pattern: str = r"\[\d+/\d+\] (p\d{5})") -> DataFrame:
    """(``id``, ``first_line``) of the ids that a log names after the line with ``marker``, in the order of their first mention.

    Lines are numbered by the place of their block in the file and their place in the block, so a long log is read by many tasks.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    where = ["_file", "_block"]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    sizes = lines.groupBy(*where).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy(*where).rowsBetween(Window.unboundedPreceding, -1))  # one row a block
    sizes = sizes.select(*where, F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = lines.withColumn("_k", F.row_number().over(Window.partitionBy(*where).orderBy("_at"))).join(sizes, where).select("value", (F.col("_before") + F.col("_k") - 1).alias("line"))
    start = numbered.filter(F.col("value").contains(marker)).agg(F.min("line").alias("start"))
    hits = numbered.join(F.broadcast(start)).filter(F.col("line") > F.col("start")).withColumn("id", F.regexp_extract("value", pattern, 1)).filter("id <> ''")
    return hits.groupBy("id").agg(F.min("line").alias("first_line"))


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(``path``, ``length``, ``content``) of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "content")


def checksums(files: DataFrame) -> DataFrame:
    """(``path``, ``length``, ``sha256``) of files."""
    from pyspark.sql import functions as F

    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def tensors(files: DataFrame) -> DataFrame:
    """(``path``, ``shape``, ``pixels``) of ``.npy`` files; a file that can't be read has null fields."""
    from collections.abc import Iterator
    from io import BytesIO

    import numpy as np
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for path, content in zip(p["path"], p["content"]):
                try:
                    a = np.load(BytesIO(content), allow_pickle=False)
                    rows.append((path, list(a.shape), a.astype(float).ravel().tolist()))
                except (ValueError, OSError, EOFError):
                    rows.append((path, None, None))
            yield pd.DataFrame(rows, columns=["path", "shape", "pixels"])

    return files.select("path", "content").mapInPandas(run, "path string, shape array<int>, pixels array<double>")


def require_all(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is asked for; an error if an asked key has no row."""
    asked = ids.select(key).distinct()
    lost = asked.join(df, key, "left_anti").count()
    if lost:
        raise LookupError(f"{lost} ids have no row")
    return df.join(asked, key, "left_semi")


def resolved_models(registry: DataFrame, overrides: DataFrame) -> DataFrame:
    """The registry (``combo_id``, ``checkpoint``) with the checkpoints that ``overrides`` (same columns) names for some of its entries."""
    from pyspark.sql import functions as F

    o = overrides.select("combo_id", F.col("checkpoint").alias("_own"))
    return registry.join(o, "combo_id", "left").withColumn("checkpoint", F.coalesce("_own", "checkpoint")).drop("_own")
