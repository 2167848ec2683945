"""The lexical audit: every statement of an answer against every retrieved sentence of its run.

``facts(run_id, fact_idx, fact)`` and ``evidence(run_id, ev_idx, sentence, source, chunk_index, chunk_text)`` meet run by run in
an equi-join; the matrix is kept as cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.functions.scores import containment, level, rouge_l
from groundline.functions.text import atomic_facts, sentences


def facts_of(responses: DataFrame, least_words: int = 3) -> DataFrame:
    """Statements of ``responses(run_id, response)``, numbered from 0."""
    return responses.select("run_id", F.posexplode(atomic_facts(F.col("response"), least_words)).alias("fact_idx", "fact"))


def evidence_of(documents: DataFrame) -> DataFrame:
    """Sentences of ``documents(run_id, doc_idx, document, source, chunk_index)``, numbered through a run; the whole chunk comes along.

    Numbers are sums over documents of a run, so no run is gathered in one place to number its sentences.
    """
    split = documents.withColumn("_s", sentences(F.col("document")))
    counts = split.select("run_id", "doc_idx", F.size("_s").alias("n"))
    before = F.sum("n").over(Window.partitionBy("run_id").orderBy("doc_idx").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("run_id", "doc_idx", F.coalesce(before, F.lit(0)).alias("_base"))
    each = split.join(base, ["run_id", "doc_idx"]).select("run_id", "_base", "source", "chunk_index", F.col("document").alias("chunk_text"), F.posexplode("_s").alias("_pos", "sentence"))
    return each.select("run_id", (F.col("_base") + F.col("_pos")).cast("int").alias("ev_idx"), "sentence", F.coalesce("source", F.lit("Unknown")).alias("source"), F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index"), "chunk_text")


def cells(facts: DataFrame, evidence: DataFrame, stemmed: bool = True) -> DataFrame:
    """``(run_id, fact_idx, ev_idx, rouge_l, exact_match, score)`` for every fact and sentence of a run. The reference text of ROUGE is the sentence."""
    met = facts.join(evidence.select("run_id", "ev_idx", "sentence"), "run_id")
    scored = met.select("run_id", "fact_idx", "ev_idx", rouge_l(F.col("sentence"), F.col("fact"), stemmed).alias("rouge_l"), containment(F.col("fact"), F.col("sentence")).alias("exact_match"))
    return scored.withColumn("score", F.greatest("rouge_l", "exact_match"))


def best_evidence(facts: DataFrame, evidence: DataFrame, matrix: DataFrame) -> DataFrame:
    """One row per fact: its best sentence, on ties the first, with all scores and the support level; no evidence scores 0."""
    best = matrix.groupBy("run_id", "fact_idx").agg(F.max_by(F.struct("ev_idx", "score", "rouge_l", "exact_match"), F.struct("score", -F.col("ev_idx"))).alias("b"))
    joined = facts.join(best, ["run_id", "fact_idx"], "left").withColumn("ev_idx", F.col("b.ev_idx")).join(evidence, ["run_id", "ev_idx"], "left")
    score = F.coalesce("b.score", F.lit(0.0))
    return joined.select(
        "run_id", "fact_idx", "fact", score.alias("support_score"), F.coalesce("sentence", F.lit("")).alias("best_evidence"), F.coalesce("source", F.lit("")).alias("best_evidence_source"),
        F.coalesce("chunk_text", "sentence", F.lit("")).alias("source_chunk_text"), F.when(F.col("source").isNotNull(), F.concat("source", F.lit("_chunk"), F.col("chunk_index").cast("string"))).otherwise("").alias("source_id"),
        F.coalesce("b.rouge_l", F.lit(0.0)).alias("rouge_l"), F.coalesce("b.exact_match", F.lit(0.0)).alias("exact_match"), level(score).alias("level"),
    )


def fact_scores(facts: DataFrame, matrix: DataFrame) -> DataFrame:
    """Largest score per fact; 0 without evidence."""
    top = matrix.groupBy("run_id", "fact_idx").agg(F.max("score").alias("score"))
    return facts.select("run_id", "fact_idx").join(top, ["run_id", "fact_idx"], "left").select("run_id", "fact_idx", F.coalesce("score", F.lit(0.0)).alias("score"))


def overall(runs: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean of a run's fact scores; 0 for a run without facts."""
    mean = scores.groupBy("run_id").agg(F.avg("score").alias("overall_score"), F.count(F.lit(1)).alias("n_facts"))
    return runs.select("run_id").join(mean, "run_id", "left").select("run_id", F.coalesce("overall_score", F.lit(0.0)).alias("overall_score"), F.coalesce("n_facts", F.lit(0)).alias("n_facts"))


def report(facts: DataFrame, evidence: DataFrame, matrix: DataFrame, results: DataFrame, totals: DataFrame) -> DataFrame:
    """A JSON report per run: its facts, evidence sentences, matrix of scores (a row per fact), results in order and the overall score.

    A run's report is one value, as large as its matrix; each list is gathered once, by run.
    """
    def listed(rows: DataFrame, order: str, value: Column, name: str) -> DataFrame:
        got = rows.select("run_id", F.struct(F.col(order).alias("at"), value.alias("v")).alias("x")).groupBy("run_id").agg(F.array_sort(F.collect_list("x")).alias(name))
        return got.withColumn(name, F.transform(name, lambda x: x["v"]))

    line = matrix.groupBy("run_id", "fact_idx").agg(F.array_sort(F.collect_list(F.struct("ev_idx", "score"))).alias("cells"))
    result = F.struct("fact", "support_score", "best_evidence", "best_evidence_source", "rouge_l", "exact_match")
    parts = {
        "atomic_facts": listed(facts, "fact_idx", F.col("fact"), "atomic_facts"), "evidence_sentences": listed(evidence, "ev_idx", F.col("sentence"), "evidence_sentences"),
        "matrix": listed(line, "fact_idx", F.transform("cells", lambda c: c["score"]), "matrix"), "attribution_results": listed(results, "fact_idx", result, "attribution_results"),
    }
    joined = totals
    for part in parts.values():
        joined = joined.join(part, "run_id", "left")
    return joined.select("run_id", F.to_json(F.struct(*(F.coalesce(n, F.array()).alias(n) for n in parts), "overall_score")).alias("report"))


def accumulated(hits: DataFrame) -> DataFrame:
    """Sources of a run in order of arrival, each ``source_id`` once: ``hits(run_id, iteration, rank, source_id, ...)``. Hits without an id
    are one source."""
    rest = [c for c in hits.columns if c not in ("run_id", "source_id")]
    first = F.min(F.struct("iteration", "rank", *[c for c in rest if c not in ("iteration", "rank")])).alias("first")
    return hits.groupBy("run_id", "source_id").agg(first).select("run_id", "source_id", *(F.col(f"first.{c}").alias(c) for c in rest))


def counters(events: DataFrame) -> DataFrame:
    """Per run: iterations and chunks retrieved."""
    n: Column = F.count(F.lit(1))
    return events.groupBy("run_id").agg(F.max("iteration").alias("total_iterations"), n.alias("n_retrieved"))
