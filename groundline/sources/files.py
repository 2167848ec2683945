"""Files and datasets as chunks and articles."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundline.functions.text import char_windows, chunk_id, chunked, cleaned, first_present, rendered, word_windows
from groundline.sources.scratch import written

# What file names are read as.
KINDS = {".pdf": "pages", ".txt": "text", ".md": "text"}


def file_kind(path: Column) -> Column:
    """``pages`` or ``text`` by the file's extension; null for others."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    out = F.lit(None).cast("string")
    for e, kind in KINDS.items():
        out = F.when(ext == e, kind).otherwise(out)
    return out


def checked_kind(path: Column) -> Column:
    """As :func:`file_kind`, but a file of another kind is an error."""
    kind = file_kind(path)
    return F.when(kind.isNull(), F.raise_error(F.concat(F.lit("unsupported file type: "), path)).cast("string")).otherwise(kind)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(text, source_file, page_num)`` of whole text files; bytes that aren't UTF-8 become replacement characters."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = raw.where(file_kind(F.col("path")) == "text")

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"text": [bytes(b).decode("utf-8", "replace") for b in part["content"]], "source_file": part["source_file"], "page_num": pd.Series([None] * len(part), dtype="Int32")})

    return files.select("content", F.element_at(F.split("path", "/"), -1).alias("source_file")).mapInPandas(decode, "text string, source_file string, page_num int")


def read_pages(spark: SparkSession, path: str, extract: Callable[[bytes], Iterable[str]]) -> DataFrame:
    """``(text, source_file, page_num)`` of paged files: ``extract`` gives a file's page texts; blank pages are left out, pages count from 1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(file_kind(F.col("path")) == "pages")

    def pages(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(t.strip(), f, n) for content, f in zip(part["content"], part["source_file"], strict=True) for n, t in enumerate(extract(bytes(content)), 1) if t.strip()]
            yield pd.DataFrame(rows, columns=["text", "source_file", "page_num"])

    return files.select("content", F.element_at(F.split("path", "/"), -1).alias("source_file")).mapInPandas(pages, "text string, source_file string, page_num int")


def chunks_of(pages: DataFrame, size: int = 200, overlap: int = 50) -> DataFrame:
    """Chunks of word windows, cut page by page: ``(text, source_file, chunk_index, page_num)``, the index running on through a file's pages. What is
    summed up along a file is one count a page, not its chunks."""
    cut = pages.withColumn("_windows", word_windows(F.col("text"), size, overlap))
    counts = cut.select(F.col("source_file").alias("_file"), F.col("page_num").alias("_page"), F.size("_windows").alias("_n"))
    before = Window.partitionBy("_file").orderBy(F.asc_nulls_first("_page")).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_file", "_page", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    placed = cut.join(base, (F.col("source_file") == F.col("_file")) & F.col("page_num").eqNullSafe(F.col("_page")))
    return placed.select(F.posexplode("_windows").alias("_pos", "text"), "source_file", "page_num", "_base").select("text", "source_file", (F.col("_base") + F.col("_pos")).cast("int").alias("chunk_index"), "page_num")


def numbered(rows: DataFrame, order: Column, name: str) -> DataFrame:
    """``rows`` with their place in ``order``, from 0, as ``name``. Ranges of rows are numbered side by side: only one count per range meets the others."""
    ranged = written(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return ranged.withColumn("_own", own).join(base, F.col("_range") == F.col("_r")).withColumn(name, F.col("_base") + F.col("_own")).drop("_range", "_r", "_own", "_base")


def articles(rows: DataFrame, order: Column, limit: int | None = None) -> DataFrame:
    """``(title, text)`` of a dataset of any columns: the first of ``context, text, passage`` it has, and of ``title, question`` or a
    number. Titles are cut to 100 characters, rows without text left out; ``limit`` takes the first rows by ``order``."""
    taken = rows.orderBy(order).limit(limit) if limit else rows
    placed = taken.withColumn("_n", F.lit(0)) if {"title", "question"} & set(rows.columns) else numbered(taken, order, "_n")
    title = first_present(rows, ("title", "question"), F.concat(F.lit("Doc_"), F.col("_n").cast("string")))
    text = first_present(rows, ("context", "text", "passage"), F.lit(""))
    return placed.select(F.substring(title, 1, 100).alias("title"), text.alias("text")).where("text <> ''")


# The columns of a source article and the labels they are rendered under.
ARTICLE = {
    "groups": ({"Type": "filter_type", "Year": "filter_year", "Rating": "Max Rating"}, {"Studio": "Animation Work", "Director": "Direction", "Music": "Music", "Original Work": "Original Work"}, {"Episodes": "Episode", "Duration": "Duration"}),
    "title": "Main Title", "titles": {"English Title": "Official Title (en)", "Japanese Title": "Official Title (ja)"}, "tail": (("Synopsis", "Synopsis", ""), ("Tags", "processed_tags", ".")), "number": "Anime_",
}


def structured_articles(rows: DataFrame, order: Column, limit: int | None = None, layout: dict = ARTICLE, least: int = 20) -> DataFrame:
    """``(title, text)`` of a dataset of described things: every column the layout names, under its label, that has a value.

    Columns that the dataset lacks count as empty, a missing title is a number in ``order``; texts under ``least`` characters are
    left out and titles cut to 200. ``limit`` takes the first rows by ``order``.
    """
    taken = numbered(rows.orderBy(order).limit(limit) if limit else rows, order, "_n")

    def value(name: str) -> Column:
        return cleaned(F.col(f"`{name}`")) if name in rows.columns else F.lit("")

    shown = {k: F.when(value(name) != "", F.concat(value(name), F.lit("/10"))).otherwise("") if k == "Rating" else value(name) for g in layout["groups"] for k, name in g.items()}
    title = F.when(value(layout["title"]) != "", value(layout["title"])).otherwise(F.concat(F.lit(layout["number"]), F.col("_n").cast("string")))
    text = rendered([{k: shown[k] for k in g} for g in layout["groups"]], [(k, value(c), end) for k, c, end in layout["tail"]], title, [(k, value(c)) for k, c in layout["titles"].items()])
    return taken.select(F.substring(title, 1, 200).alias("title"), text.alias("text")).where(F.length("text") >= least)


def vector_rows(arts: DataFrame, embedding: Callable[[Column], Column], size: int = 500, overlap: int = 50) -> DataFrame:
    """Rows of a vector collection: ``(id, document, embedding, source, chunk_index)`` of every chunk of articles."""
    each = chunked(arts, char_windows(F.col("text"), size, overlap))
    return each.select(chunk_id(F.col("title"), F.col("chunk_index")).alias("id"), F.col("text").alias("document"), embedding(F.col("text")).alias("embedding"), F.col("title").alias("source"), "chunk_index")


def hits_to_documents(hits: DataFrame) -> DataFrame:
    """Hits as documents with the metadata that sentence evidence is read from."""
    return hits.select("*", F.struct("source", "chunk_index").alias("metadata"))


