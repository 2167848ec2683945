"""The triple graph as tables: entities, edges and documents, with upserts, statistics and merges.

``entities(normalized_name, name)``, ``edges(src_norm, dst_norm, predicate, chunk_text, source_file, chunk_index,
predicate_embedding)``, ``documents(name, ingested_at, num_chunks, num_triples, status)``. An upsert returns the new table and
leaves writing it to the caller (see ``sources.store``), so a batch is there whole or not at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.functions.text import normalized


def mentions(triples: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Entities named by a batch of triples: of equal normalised names the first display name, subjects before objects."""
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    both = triples.select(F.explode(F.array(*(F.struct(normalized(F.col(c)).alias("normalized_name"), F.col(c).alias("name"), F.struct(rank, F.lit(i)).alias("at")) for i, c in enumerate(("subject", "obj"))))).alias("m")).select("m.*")
    return both.groupBy("normalized_name").agg(F.min_by("name", "at").alias("name"))


def upsert_entities(entities: DataFrame, triples: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Entities with those of ``triples`` that are new; known ones keep their name."""
    return entities.select("normalized_name", "name").unionByName(mentions(triples, order).join(entities, "normalized_name", "left_anti"))


def edges_of(triples: DataFrame) -> DataFrame:
    """An edge per triple, equal ones too. A batch without embeddings gets null ones."""
    vector = F.col("predicate_embedding") if "predicate_embedding" in triples.columns else F.lit(None).cast("array<float>")
    return triples.select(
        normalized(F.col("subject")).alias("src_norm"), normalized(F.col("obj")).alias("dst_norm"), "predicate", "chunk_text", "source_file", F.col("chunk_index").cast("int").alias("chunk_index"), vector.alias("predicate_embedding"),
    )


def replace_source(edges: DataFrame, fresh: DataFrame) -> DataFrame:
    """Edges with those of every source of ``fresh`` replaced by it: ingesting a file again doesn't double it."""
    return edges.join(fresh.select("source_file").distinct(), "source_file", "left_anti").unionByName(fresh)


def upsert_documents(catalog: DataFrame, fresh: DataFrame) -> DataFrame:
    """Documents by name; of equal names the latest row counts, those of ``fresh`` over those of ``catalog``. Nameless rows are left out."""
    both = catalog.withColumn("_new", F.lit(0)).unionByName(fresh.where("coalesce(name, '') <> ''").withColumn("_new", F.lit(1)))
    columns = [c for c in catalog.columns if c != "name"]
    last = F.max(F.struct("_new", "ingested_at", *[c for c in columns if c != "ingested_at"])).alias("last")
    return both.groupBy("name").agg(last).select(*(("name" if c == "name" else F.col(f"last.{c}")) for c in catalog.columns))


def document_list(catalog: DataFrame) -> DataFrame:
    """The catalog, newest first."""
    return catalog.orderBy(F.desc_nulls_first("ingested_at"), "name")


def stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: ``nodes, relations``; nodes are counted without edges too."""
    return entities.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("relations")))  # one row each


def canonical_names(entities: DataFrame, labels: DataFrame) -> DataFrame:
    """``(normalized_name, canonical)`` for each member of a cluster of two or more: the longest name, on ties the first normalised one.

    ``labels(normalized_name, label)`` are cluster labels.
    """
    named = labels.join(entities, "normalized_name")
    best = named.groupBy("label").agg(F.min_by("normalized_name", F.struct((-F.length("name")).alias("l"), "normalized_name")).alias("canonical"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return named.join(best, "label").select("normalized_name", "canonical")


def merge_entities(entities: DataFrame, edges: DataFrame, canon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities without merged names, and edges moved to the canonical ones.

    Edges inside a cluster go, but for loops that already stood on its canonical entity.
    """
    gone = canon.where("normalized_name <> canonical")
    a, b = (canon.select(F.col("normalized_name").alias(k), F.col("canonical").alias(f"_{k}")) for k in ("src_norm", "dst_norm"))
    moved = edges.join(a, "src_norm", "left").join(b, "dst_norm", "left").withColumns({"_s": F.coalesce("_src_norm", "src_norm"), "_d": F.coalesce("_dst_norm", "dst_norm")})
    inside = F.col("_src_norm").isNotNull() & (F.col("_s") == F.col("_d"))
    stood = (F.col("src_norm") == F.col("_s")) & (F.col("dst_norm") == F.col("_d"))
    kept = moved.where(~inside | stood).select(*(F.col("_s").alias(c) if c == "src_norm" else F.col("_d").alias(c) if c == "dst_norm" else c for c in edges.columns))
    return entities.join(gone.select("normalized_name"), "normalized_name", "left_anti"), kept


def ingest_totals(chunks: DataFrame, triples: DataFrame, failed: DataFrame, batch: int = 16) -> DataFrame:
    """Per source file: chunks, triples, batches and status; a file with any failed batch is an error."""
    n_chunks = chunks.groupBy("source_file").agg(F.count(F.lit(1)).alias("num_chunks"))
    n_triples = triples.groupBy("source_file").agg(F.count(F.lit(1)).alias("num_triples"))
    bad = failed.select("source_file").distinct().withColumn("_bad", F.lit(True))
    joined = n_chunks.join(n_triples, "source_file", "left").join(bad, "source_file", "left")
    return joined.select("source_file", "num_chunks", F.coalesce("num_triples", F.lit(0)).cast("long").alias("num_triples"), F.ceil(F.col("num_chunks") / batch).cast("long").alias("num_batches"), F.when(F.col("_bad"), "error").otherwise("done").alias("status"))


def upsert_vectors(collection: DataFrame, fresh: DataFrame, order: Sequence[str]) -> DataFrame:
    """A vector collection with ``fresh`` put in by id; of equal ids in ``fresh`` the last by ``order`` counts."""
    last = Window.partitionBy("id").orderBy(*(F.desc(c) for c in order))
    new = fresh.withColumn("_n", F.row_number().over(last)).where("_n = 1").select(*collection.columns)
    return collection.join(new.select("id"), "id", "left_anti").unionByName(new)
