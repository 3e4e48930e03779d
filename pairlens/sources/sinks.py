"""Writers that never overwrite, and small renderings on the driver."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame
from pyspark.sql.utils import AnalysisException


def write_new(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> str:
    """Write to ``path``, or to a sibling with the time in its name if something is there; the path that was written."""
    for attempt in range(10):
        target = path if attempt == 0 else f"{path}_{time.strftime('%Y%m%d-%H%M%S')}" + (f"-{attempt}" if attempt > 1 else "")
        try:
            w = df.write.mode("errorifexists").format(kind)
            (w.option("header", True) if kind == "csv" else w).partitionBy(*partition_by).save(target)
            return target
        except AnalysisException as e:
            if "PATH_ALREADY_EXISTS" not in str(e):
                raise
    raise FileExistsError(path)


def write_splits(df: DataFrame, path: str, key: str) -> tuple[str, DataFrame]:
    """One folder of sorted CSV for each ``split``, and the manifest (``split``, ``n``)."""
    done = write_new(df.repartition("split").sortWithinPartitions("split", key), path, "csv", ("split",))
    return done, df.groupBy("split").count().withColumnRenamed("count", "n")


def _cells(df: DataFrame, most: int) -> tuple[list[str], list[list[str]]]:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table has at most {most} rows")
    return df.columns, [["" if v is None else str(v) for v in r] for r in rows]


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; more than ``most`` rows are an error, not cut."""
    head, rows = _cells(df, most)
    return "\n".join("| " + " | ".join(x.replace("|", "\\|") for x in r) + " |" for r in (head, ["---"] * len(head), *rows))


def latex_table(df: DataFrame, most: int = 1000) -> str:
    """A small table as a LaTeX tabular."""
    head, rows = _cells(df, most)
    safe = lambda x: re.sub(r"([&%_#$])", r"\\\1", x)
    body = " \\\\\n".join(" & ".join(map(safe, r)) for r in (head, *rows))
    return f"\\begin{{tabular}}{{{'l' * len(head)}}}\n{body} \\\\\n\\end{{tabular}}"


def fill_placeholders(text: str, values: dict[str, object]) -> tuple[str, list[str]]:
    """``text`` with «NAME» replaced, and the names that are left over, sorted."""
    out = re.sub(r"«([A-Z0-9_]+)»", lambda m: str(values.get(m[1], m[0])), text)
    return out, sorted(set(re.findall(r"«([A-Z0-9_]+)»", out)))
