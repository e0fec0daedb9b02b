"""Writes that can be repeated."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    jpath, fs = _fs(spark, path)
    return fs.exists(jpath)


def replace_atomically(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write beside ``path`` and rename, so readers see the old table or the new one, never a part.

    ``df`` may read the table it replaces.
    """
    spark = df.sparkSession
    staged, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(staged)
    target, fs = _fs(spark, path)
    make = spark._jvm.org.apache.hadoop.fs.Path
    there = fs.exists(target)
    if there and not fs.rename(target, make(old)):
        raise OSError(f"can't move {path}")
    if not fs.rename(make(staged), target):
        if there:
            fs.rename(make(old), target)
        raise OSError(f"can't move {staged}")
    if there:
        fs.delete(make(old), True)


def upsert(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Rows of ``df`` replace those of the table with the same key; others are added. Of incoming rows with one
    key the greatest by all columns is taken; NULL keys are equal."""
    spark = df.sparkSession
    rows = df.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).agg(F.max(F.struct(*df.columns)).alias("_row")).select("_row.*")
    if exists(spark, path):
        new = rows.select(*[F.col(k).alias(f"_n{i}") for i, k in enumerate(keys)])
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_n{i}"))
        rows = spark.read.parquet(path).join(new, same, "left_anti").unionByName(rows, allowMissingColumns=True)
    replace_atomically(rows, path)


def pending(source: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows whose key is not done yet: the whole backlog in one job, whatever its size."""
    return source.join(done.select(*keys), list(keys), "left_anti")


def ensure_table(spark: SparkSession, name: str, ddl: str, partition_by: str | None = None) -> None:
    """Create a Parquet table unless it is there. ``name`` must be a plain identifier."""
    if not re.fullmatch(r"\w+(\.\w+)?", name):
        raise ValueError(f"not a table name: {name!r}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet" + (f" PARTITIONED BY ({partition_by})" if partition_by else ""))


def write_json_lines(df: DataFrame, path: str) -> None:
    """Results as JSON lines, a new folder per run."""
    df.write.mode("errorifexists").json(path)


def with_section(markdown: str, title: str, body: str) -> str:
    """A report with the section under ``## title`` replaced, or added at the end."""
    pattern = re.compile(rf"(^## {re.escape(title)}\n)(.*?)(?=^## |\Z)", re.M | re.S)
    section = f"## {title}\n\n{body.strip()}\n\n"
    if pattern.search(markdown):
        return pattern.sub(lambda _: section, markdown, count=1).rstrip("\n") + "\n"
    return f"{markdown.rstrip()}\n\n{section}".rstrip("\n") + "\n"
