"""Retrieve and resume: generations stop at a tag, what it asks for is retrieved, and they go on; a batch of runs at a time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.operators.audit import accumulated
from groundline.plans import prompts
from groundline.providers import TextGenerator, column
from groundline.sources.scratch import written
from groundline.streaming.stop_tag import stop_parts

HITS = ("document", "source", "chunk_index", "distance", "source_id")


@dataclass
class Runs:
    """What a batch of runs leaves: ``results(run_id, question, intermediate_text, final_response, total_iterations)``, the searches
    ``events(run_id, iteration, query, partial_text)``, what they found, and each run's sources once."""

    results: DataFrame
    events: DataFrame
    hits: DataFrame
    sources: DataFrame


def generated(runs: DataFrame, prompt: Column, model: TextGenerator) -> DataFrame:
    """``runs`` with ``new_text, query, stopped`` of the model's next words; an old ``query`` gives way. Written out, since a model may answer differently twice."""
    full = written(runs.withColumn("_full", column(model.generate, "string", prompt)), "generated")
    text, query, stopped = stop_parts(F.coalesce("_full", F.lit("")))
    return full.select(*(c for c in runs.columns if c != "query"), text.alias("new_text"), query.alias("query"), stopped.alias("stopped"))


def started(questions: DataFrame, model: TextGenerator) -> DataFrame:
    """First words for ``questions(run_id, question)``."""
    return generated(questions, prompts.initial(F.col("question")), model)


def resumed(active: DataFrame, sources: DataFrame, model: TextGenerator) -> DataFrame:
    """Next words for ``active(run_id, question, partial, query)`` with the sources found so far."""
    held = sources.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("iteration", "rank", "source", "document"))).alias("_sources"))
    joined = active.join(held, "run_id", "left").withColumn("_sources", F.coalesce("_sources", F.array().cast("array<struct<iteration:int,rank:int,source:string,document:string>>")))
    return generated(joined, prompts.resumed(F.col("question"), F.col("partial"), F.col("query"), F.col("_sources")), model).drop("_sources")


def run(questions: DataFrame, model: TextGenerator, retrieve: Callable[[DataFrame], DataFrame], *, iterations: int = 3) -> Runs:
    """Runs every question to its end, in at most ``iterations`` searches each.

    ``retrieve(queries(run_id, query))`` returns ``(run_id, rank, document, source, chunk_index, distance, source_id)``. Non-empty new
    text takes the place of the old. A run that never asks is searched for with its question and written anew. An empty refinement
    keeps the draft.
    """
    first = started(questions, model)
    state = first.select("run_id", "question", F.col("new_text").alias("text"), "query", "stopped", F.lit(0).alias("n"))
    events = hits = None

    def search(asked: DataFrame, n: int, label: Column) -> None:
        nonlocal events, hits
        found = written(retrieve(asked.select("run_id", "query")).select("run_id", F.lit(n).alias("iteration"), "rank", *HITS), "hits")
        event = asked.select("run_id", F.lit(n).alias("iteration"), label.alias("query"), F.col("text").alias("partial_text"))
        events, hits = (event, found) if events is None else (events.unionByName(event), hits.unionByName(found))

    fallback = state.where("not stopped").withColumn("query", F.col("question"))
    search(fallback, 1, F.concat(F.lit("[FALLBACK] "), F.col("question")))
    again = resumed(fallback.select("run_id", "question", F.lit("").alias("partial"), F.lit(None).cast("string").alias("query")), accumulated(hits), model)
    done = again.select("run_id", "question", F.col("new_text").alias("text"), F.lit(1).alias("n"))
    active = state.where("stopped")
    for n in range(1, iterations + 1):
        search(active, n, F.col("query"))
        more = resumed(active.select("run_id", "question", F.col("text").alias("partial"), "query"), accumulated(hits), model)
        after = more.select("run_id", "question", F.when(F.col("new_text") != "", F.col("new_text")).otherwise(F.col("partial")).alias("text"), "query", "stopped", F.lit(n).alias("n"))
        goes_on = F.col("stopped") & F.lit(n < iterations)
        done = done.unionByName(after.where(~goes_on).select("run_id", "question", "text", "n"))
        active = after.where(goes_on)
    refined = written(done.withColumn("_new", column(model.generate, "string", prompts.refined(F.col("text")))), "refined")
    clean = F.trim(F.coalesce("_new", F.lit("")))
    results = refined.select("run_id", "question", F.col("text").alias("intermediate_text"), F.when(clean != "", clean).otherwise(F.col("text")).alias("final_response"), F.col("n").alias("total_iterations"))
    return Runs(results, events, hits, accumulated(hits))
