"""Minibatch ingest: chunks stream in, are resolved, extracted, embedded and written; a failed minibatch is noted and skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline import providers
from groundline.functions.markup import extracted
from groundline.operators.graph import upsert_documents
from groundline.sources.store import GraphStore

#: Chunks that a model is given at a time, and that fail together.
BATCH = 16


def read_chunks(chunks: DataFrame, model: providers.TripleModel, coref: providers.CoreferenceModel, batch: int = BATCH) -> DataFrame:
    """``chunks(text, source_file, chunk_index)`` with the ``beams`` of their resolved text and the ``error`` of a minibatch that failed. The
    chunk's own words are kept as ``chunk_text``."""
    tried = chunks.select("source_file", "chunk_index", F.col("text").alias("chunk_text"), providers.attempted(model.beams, "array<string>", providers.resolved(coref, F.col("text")), batch).alias("r"))
    return tried.select("source_file", "chunk_index", "chunk_text", F.col("r.value").alias("beams"), F.col("r.error").alias("error"))


def triples_of_chunks(read: DataFrame, embedder: providers.Embedder) -> DataFrame:
    """Triples of :func:`read_chunks` with their predicate's embedding."""
    found = extracted(read.where("error is null").drop("error")).withColumnRenamed("object", "obj")
    return found.withColumn("predicate_embedding", providers.column(embedder.encode, "array<float>", F.col("predicate")))


def ingest_stream(
    chunks: DataFrame, store: GraphStore, checkpoint: str, *, model: providers.TripleModel, coref: providers.CoreferenceModel | None = None, embedder: providers.Embedder | None = None, batch: int = BATCH,
):
    """Starts a query that writes a stream of chunks to ``store`` and ends when what is there has been read.

    Models read minibatches of ``batch`` chunks. One that fails marks the documents it holds as errors, for good, and the rest go on. A
    document's counts add up over what arrives. Triples, counts and the stream's epoch are one commit, so an epoch that is replayed
    after a failure is skipped if it was committed, and written once if not. If writing fails, the documents of that epoch are errors.
    """
    def write(arrived: DataFrame, epoch: int) -> None:
        if epoch <= store.seen(checkpoint):
            return
        read = read_chunks(arrived, model, coref or providers.SameText(), batch).persist()
        try:
            triples = triples_of_chunks(read, embedder or providers.HashingEmbedder()).persist()
            own = read.groupBy(F.col("source_file").alias("name")).agg(F.count(F.lit(1)).alias("c"), F.max(F.col("error").isNotNull()).alias("bad"))
            counts = triples.groupBy(F.col("source_file").alias("name")).agg(F.count(F.lit(1)).alias("t"))
            try:
                store.write_triples(triples, documents=catalog(own.join(counts, "name", "left")), epoch=(checkpoint, epoch))
            except Exception:  # noqa: BLE001 - what can't be written must not end the ingest
                store.commit({"documents": catalog(own.withColumns({"t": F.lit(0), "bad": F.lit(True)}))}, epoch=(checkpoint, epoch))
            triples.unpersist()
        finally:
            read.unpersist()

    def catalog(fresh: DataFrame) -> DataFrame:
        """The documents with ``fresh(name, c, t, bad)`` added to their counts."""
        held = store.table("documents")
        old = held.withColumnsRenamed({"num_chunks": "oc", "num_triples": "ot", "status": "os"}).drop("ingested_at")
        bad = F.col("bad") | (F.coalesce("os", F.lit("done")) == "error")
        rows = fresh.join(old, "name", "left").select(
            "name", F.current_timestamp().alias("ingested_at"), (F.col("c") + F.coalesce("oc", F.lit(0))).alias("num_chunks"), (F.coalesce("t", F.lit(0)) + F.coalesce("ot", F.lit(0))).alias("num_triples"), F.when(bad, "error").otherwise("done").alias("status"),
        )
        return upsert_documents(held, rows)

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
