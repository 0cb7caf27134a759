"""Scans, sinks and the name registry of datasets."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def datalines(spark: SparkSession, rows: Iterable[Sequence], schema: str, informats: dict[str, str] | None = None, lengths: dict[str, int] | None = None) -> DataFrame:
    """Inline rows; informats turn text into dates or numbers, lengths cut text."""
    from ..functions.scalar import input_

    df = spark.createDataFrame([tuple(r) for r in rows], schema)
    for name, informat in (informats or {}).items():
        df = df.withColumn(name, input_(F.col(name), informat))
    for name, n in (lengths or {}).items():
        df = df.withColumn(name, F.substring(name, 1, n))
    return df


def parse_datalines(spark: SparkSession, text: str, columns: Sequence[tuple[str, str]], informats: dict[str, str] | None = None, lengths: dict[str, int] | None = None) -> DataFrame:
    """Rows of blank-separated text; columns are (name, 'string' or 'double').  A single dot is missing."""
    rows = []
    for line in text.splitlines():
        if parts := line.split():
            values = [None if p == "." else p for p in (*parts, *["."] * len(columns))][: len(columns)]
            rows.append([float(v) if v is not None and kind == "double" and name not in (informats or {}) else v for v, (name, kind) in zip(values, columns, strict=True)])
    schema = ", ".join(f"`{n}` {'string' if n in (informats or {}) else k}" for n, k in columns)
    return datalines(spark, rows, schema, informats, lengths)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, drop_malformed: bool = False) -> DataFrame:
    """CSV with a header; types are inferred only where no schema is given."""
    reader = spark.read.option("header", True)
    if drop_malformed:
        reader = reader.option("mode", "DROPMALFORMED")
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def save_table(df: DataFrame, name: str, mode: str = "overwrite", bucket_by: Sequence[str] = (), buckets: int = 0) -> None:
    """Managed table, bucketed for later joins if asked."""
    writer = df.write.mode(mode)
    (writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by) if buckets else writer).saveAsTable(name)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files (INFILE without columns)."""
    return spark.read.text(path)


class Library:
    """Datasets by one- or two-level name, in any case; one level means WORK.

    A name keeps its versions, so a step that rewrites its input reads the
    version before it.  Library names with a path read and write Parquet there.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}
        self._versions: dict[str, list[DataFrame]] = {}

    @staticmethod
    def key(name: str) -> str:
        name = name.lower()
        return name if "." in name else f"work.{name}"

    def put(self, name: str, df: DataFrame) -> None:
        self._versions.setdefault(self.key(name), []).append(df)

    def get(self, name: str, version: int = -1) -> DataFrame:
        key = self.key(name)
        if key in self._versions:
            return self._versions[key][version]
        lib, _, table = key.partition(".")
        if lib in self.paths:
            return self.spark.read.parquet(f"{self.paths[lib]}/{table}.parquet")
        raise KeyError(f"dataset {name} does not exist")

    def __contains__(self, name: str) -> bool:
        return self.key(name) in self._versions or self.key(name).partition(".")[0] in self.paths

    def versions(self, name: str) -> int:
        return len(self._versions.get(self.key(name), ()))

    def delete(self, name: str) -> None:
        self._versions.pop(self.key(name), None)

    def names(self) -> list[str]:
        return sorted(self._versions)

    def register_views(self) -> dict[str, str]:
        """Temp views of the current versions, for SQL text: dataset name to view name."""
        views = {}
        for key, versions in self._versions.items():
            views[key] = key.removeprefix("work.").replace(".", "__")
            versions[-1].createOrReplaceTempView(views[key])
        return views
