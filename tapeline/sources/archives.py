"""Bulk archives: zipped text files, listed in a master file, filtered by terms. All on frames: a task per archive."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.io import guard_output, under, write_csv
from tapeline.sources.http import Retrying

SUFFIX = ".gkg.csv.zip"
#: Lines that go to Spark at a time.
CHUNK = 10_000


def archive_day(url: Column) -> Column:
    """The day in the first eight characters of an archive's name; null for another name."""
    return F.try_to_date(F.substring(F.substring_index(url, "/", -1), 1, 8), "yyyyMMdd")


def archive_table(master: DataFrame, start: date, end: date, suffix: str = SUFFIX, most: int | None = None) -> DataFrame:
    """(archive_url, archive_date) of the archives of a span, by name, from the lines of a master list (column `value`).

    A line's last word is the archive; other files and blank lines are left out. `most` keeps the first so many.
    """
    rows = master.select(F.substring_index(F.regexp_replace(F.btrim("value", F.lit(" \t\r\n")), r"\s+", " "), " ", -1).alias("archive_url"))
    rows = rows.withColumn("archive_date", archive_day(F.col("archive_url"))).filter(F.endswith("archive_url", F.lit(suffix)) & F.col("archive_date").between(F.lit(start), F.lit(end)))
    rows = rows.orderBy("archive_url")
    return rows if most is None else rows.limit(most)


def unzip_lines(content: bytes) -> Iterator[list[str]]:
    """The lines of all files of an archive, CHUNK at a time; bytes that are no UTF-8 are replaced."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for entry in archive.infolist():
            if not entry.is_dir():
                with io.TextIOWrapper(archive.open(entry), encoding="utf-8", errors="replace", newline="\n") as text:
                    while some := text.readlines(CHUNK * 100):
                        yield [line.removesuffix("\n") for line in some]


def archive_lines(files: DataFrame) -> DataFrame:
    """(archive_url, row_text) of every line of zip files with columns path and content."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path, content in ((r.path, r.content) for b in batches for r in b.itertuples()):
            yield from (pd.DataFrame({"archive_url": path, "row_text": some}) for some in unzip_lines(content))

    return files.select("path", "content").mapInPandas(lines, "archive_url string, row_text string")


def matching(lines: DataFrame, terms: Sequence[str], text: str = "row_text") -> DataFrame:
    """Lines that hold any of the terms, case aside."""
    if not terms:
        raise ValueError("at least one filter term is needed")
    lowered = F.lower(F.col(text))
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(lowered, F.lit(t.lower()))
    return lines.filter(hit)


def read_archives(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def manifest(archives: DataFrame, matched: DataFrame) -> DataFrame:
    """(archive_url, archive_date, matched_rows): every archive, those without a match too."""
    counted = matched.groupBy("archive_url").agg(F.count(F.lit(1)).alias("n"))
    return archives.select("archive_url").distinct().join(counted, "archive_url", "left").select("archive_url", archive_day(F.col("archive_url")).alias("archive_date"), F.coalesce("n", F.lit(0)).alias("matched_rows"))


@dataclass(frozen=True)
class ArchiveSpec:
    master_url: str
    raw_dir: str
    start: date
    end: date
    terms: tuple[str, ...]
    most: int | None = None
    keep_archives: bool = False

    def path(self, kind: str) -> str:
        return under(self.raw_dir, f"{kind}_{self.start:%Y%m%d}_{self.end:%Y%m%d}")


def fetched(archives: DataFrame, fetch: Callable[[str], bytes]) -> DataFrame:
    """(path, content): each archive fetched by a task; `fetch` goes to the workers, and Spark repeats a failed task."""

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for url in (u for b in batches for u in b["archive_url"]):
            yield pd.DataFrame({"path": [url], "content": [fetch(url)]})

    return archives.select("archive_url").mapInPandas(contents, "path string, content binary")


def collect_archives(spark: SparkSession, spec: ArchiveSpec, client: Retrying, fetch: Callable[[str], bytes], parallel: int = 4, progress: Callable[[dict], None] | None = None) -> dict:
    """Extract and manifest of the archives of a span: {extract, manifest, archives, rows}.

    The master list comes through `client`, the archives through `fetch`, `parallel` at a time. Both outputs are raw
    data: an existing one is always an error, before anything is fetched. Archives are kept (as Parquet of path and
    content) only if the spec says so.
    """
    if spec.start > spec.end:
        raise ValueError("the start must not be after the end")
    if not spec.terms:
        raise ValueError("at least one filter term is needed")
    tell = progress or (lambda event: None)
    extract, listing, kept = (guard_output(spec.path(k)) for k in ("archive_extract", "archive_manifest", "archives"))
    master = spark.createDataFrame([(line,) for line in client.get(spec.master_url, {}).text.splitlines()], "value string")
    urls = [r[0] for r in archive_table(master, spec.start, spec.end, most=spec.most).collect()]  # names only, some per quarter of an hour
    tell({"phase": "archives", "count": len(urls)})
    archives = spark.createDataFrame([(u,) for u in urls], "archive_url string").repartition(max(1, min(parallel, len(urls))))
    content = fetched(archives, fetch)
    if spec.keep_archives:
        content.write.mode("errorifexists").parquet(kept)
        content = spark.read.parquet(kept)
    write_csv(matching(archive_lines(content), spec.terms), extract, single=False)
    rows = spark.read.schema("archive_url string, row_text string").option("header", True).option("escape", '"').option("multiLine", True).csv(extract)
    counts = manifest(archives, rows)
    write_csv(counts.orderBy("archive_url"), listing)
    total = rows.count()
    tell({"phase": "done", "rows": total})
    return {"extract": extract, "manifest": listing, "archives": len(urls), "rows": total}
