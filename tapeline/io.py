"""Tables, CSV and JSON scans and sinks, and the guards around them."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class OutputError(ValueError):
    """An output that may not be written."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def blank_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing text is the empty string: a CSV's empty field is read as null, so it is put back."""
    wanted = [c for c, kind in df.dtypes if kind == "string"] if columns is None else columns
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in wanted})


def read_text_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV with a header, every column text, quoted fields over several lines allowed, missing values ''."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST").option("enforceSchema", False)
    if columns is not None:
        reader = reader.schema(text_schema(columns))
    return blank_nulls(reader.csv(path))


def read_json_object(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file holding one JSON object; anything else fails."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def _located(path: str):
    """(file system, qualified path) of a path of any scheme, as Spark itself would resolve it."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def under(folder: str, *names: str) -> str:
    return "/".join([folder.rstrip("/"), *names])


def path_exists(path: str) -> bool:
    fs, p = _located(path)
    return fs.exists(p)


def normal_path(path: str) -> str:
    """A path with scheme and host, without dots and, on the local disk, without links."""
    _, p = _located(path)
    uri = p.toUri().normalize()
    return f"file:{os.path.realpath(uri.getPath())}" if uri.getScheme() == "file" else uri.toString().rstrip("/")


def list_files(folder: str, suffix: str = "") -> list[str]:
    """The files below a folder, at any depth, in order of their paths; none for a folder that isn't there."""
    fs, p = _located(folder)
    if not fs.exists(p):
        return []
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        found.append(files.next().getPath().toString())
    return sorted(f for f in found if f.endswith(suffix))


def write_new_text(path: str, text: str) -> None:
    """A small file that must not be there yet; folders are made as needed."""
    fs, p = _located(path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def label_files(path: str) -> list[str]:
    """The file itself, or the sorted CSV files of a folder; none is an error."""
    fs, p = _located(path)
    if fs.exists(p) and not fs.getFileStatus(p).isDirectory():
        return [path]
    found = sorted(str(f.getPath().toString()) for f in fs.listStatus(p) if f.isFile() and f.getPath().getName().endswith(".csv")) if fs.exists(p) else []
    if not found:
        raise FileNotFoundError(f"no label CSV under {path}")
    return found


def read_label_union(spark: SparkSession, path: str, file_column: str = "_annotation_file") -> DataFrame:
    """Label CSVs with differing headers, one below the other, with the name of the file each row came from."""
    out = None
    for f in label_files(path):
        part = read_text_csv(spark, f).withColumn(file_column, F.lit(f.rsplit("/", 1)[-1]))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return blank_nulls(out)


def guard_output(path: str, overwrite: bool = False, raw_dir: str | None = None) -> str:
    """Refuses an existing output unless told otherwise, and always anything inside the raw folder, on any file system."""
    if raw_dir is not None:
        full, raw = normal_path(path), normal_path(raw_dir)
        if full == raw or full.startswith(raw.rstrip("/") + "/"):
            raise OutputError(f"{path} lies in the raw folder, which is never rewritten")
    if not overwrite and path_exists(path):
        raise OutputError(f"{path} exists; pass overwrite to replace it")
    return path


def write_csv(df: DataFrame, path: str, overwrite: bool = False, raw_dir: str | None = None, single: bool = True) -> None:
    """CSV with a header (for no rows too), nulls as blanks. `single` is for results that are small by nature."""
    guard_output(path, overwrite, raw_dir)
    out = df.coalesce(1) if single else df
    out.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)


def write_raw_json(df: DataFrame, path: str) -> None:
    """Raw deliveries are immutable: an existing path always fails."""
    df.write.mode("errorifexists").json(path)


def row_count(df: DataFrame) -> int:
    return df.count()
