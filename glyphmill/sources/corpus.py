"""Scans of HTML corpora, stop-word files, generated and canned pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Folder


def html_files(spark: SparkSession, path: str, max_id: int | None = None) -> DataFrame:
    """(page_id, url, html) of the files page_<id>.html of a folder, one row a
    file. Other names are skipped; ``max_id`` drops larger ids."""
    found = spark.read.text(path, wholetext=True, pathGlobFilter="page_*.html")
    name = F.input_file_name()
    rows = found.select(F.regexp_extract(name, r"page_([0-9]+)\.html$", 1).alias("n"), name.alias("url"), F.col("value").alias("html"))
    rows = rows.where("n != ''").select(F.col("n").cast("long").alias("page_id"), "url", "html")
    return rows if max_id is None else rows.where(F.col("page_id").between(1, max_id))


def write_html_files(pages: DataFrame, path: str, id_col: str = "page_id", html_col: str = "html") -> int:
    """Writes every page to a file page_<id>.html of a folder; gives their number.
    A task that is run again writes the same files again."""
    folder = Folder(pages.sparkSession, path).qualified()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa_fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        n = 0
        for batch in batches:
            for id_, html in zip(*batch.columns):
                with store.open_output_stream(f"{root}/page_{id_.as_py()}.html") as out:
                    out.write((html.as_py() or "").encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(html_col).cast("string"))
    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def stop_words(spark: SparkSession, path: str, most: int = 100_000) -> list[str]:
    """One word a line, left-trimmed, blank lines skipped; replaces the defaults."""
    rows = spark.read.text(path).select(F.ltrim("value").alias("w")).where("w != ''").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a stop-word list has at most {most} words")
    return [r["w"] for r in rows]


_PAGE = (
    '<!DOCTYPE html>\n<html><head><title>%s</title><meta name="category" content="%s"><meta name="keywords" content="%s"><meta name="description" content="%s"></head>\n'
    '<body><h1>%s</h1>\n<p>%s</p>\n<h2>Related</h2>\n<p><a href="/page/%s">next</a> <a href="/page/%s">previous</a></p>\n</body></html>'
)


def generated_pages(records: DataFrame) -> DataFrame:
    """Renders (id, title, category, keywords, description, heading, content,
    link1, link2) records as pages."""
    text = [F.col(c).cast("string") for c in ("title", "category", "keywords", "description", "heading", "content", "link1", "link2")]
    return records.select(F.col("id").cast("long").alias("page_id"), F.concat(F.lit("/page/"), F.col("id").cast("string")).alias("url"), F.format_string(_PAGE, *text).alias("html"))


def canned_search(docs: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows with the text in any column; all rows if there is none."""
    hit = F.lit(False)
    for c in columns:
        hit |= F.lower(c).contains(text.lower())
    marked = docs.withColumn("_hit", hit)
    some = marked.agg(F.coalesce(F.max("_hit"), F.lit(False)).alias("_some"))
    return marked.crossJoin(F.broadcast(some)).where("_hit or not _some").drop("_hit", "_some")
