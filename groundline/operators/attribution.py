"""Attribution of claims and questions to the triple graph: exact match, nearest predicate, partial triples, and the cascade.

All work on batches: ``claims(claim_id, claim, subject, predicate, obj, predicate_vector)`` and ``edges`` as in
``operators.graph`` with an ``edge_norm`` of each embedding (see :func:`with_norms`). Where the order of matches would be
arbitrary, the edge first by source file, chunk, predicate and end names counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.functions.markup import triples_of
from groundline.functions.scores import cosine, norm
from groundline.functions.text import is_question, normalized, slot_facts, slots, strip
from groundline.providers import Embedder, TripleModel, column

THRESHOLD, TOP_K, POOL = 0.75, 5, 200
#: The order that settles ties.
PLACE = ("source_file", "chunk_index", "predicate", "src_norm", "dst_norm")
EVIDENCE = ("predicate", "chunk_text", "source_file", "chunk_index")


def with_norms(edges: DataFrame) -> DataFrame:
    """Edges with the norm of their embedding, computed once for all comparisons."""
    return edges.withColumn("edge_norm", F.when(F.size("predicate_embedding") > 0, norm(F.col("predicate_embedding"))))


def exact_matches(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """``(claim_id, hit)`` for claims whose triple stands in the graph: directed, the predicate's case and outer space aside.

    Of equal edges the first is found by an aggregate before the join, so a hot edge is one row there and a claim meets one at most.
    """
    asked = claims.select("claim_id", normalized(F.col("subject")).alias("src_norm"), normalized(F.col("obj")).alias("dst_norm"), normalized(F.col("predicate")).alias("p"))
    hit = F.min_by(F.struct(*EVIDENCE), F.struct(*PLACE)).alias("hit")
    stored = edges.groupBy("src_norm", "dst_norm", F.lower("predicate").alias("p")).agg(hit)
    return asked.join(stored, ["src_norm", "dst_norm", "p"]).select("claim_id", "hit")


def _scored(asked: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``asked`` joined with edges that have an embedding, and the cosine of the predicates."""
    named = edges.where(F.col("edge_norm").isNotNull()).withColumnsRenamed({c: f"e_{c}" for c in EVIDENCE})
    return asked.withColumn("q_norm", norm(F.col("predicate_vector"))).join(named, keys).withColumn("similarity", cosine(F.col("predicate_vector"), F.col("predicate_embedding"), F.col("q_norm"), F.col("edge_norm")))


def _best(score: Column) -> list[Column]:
    return [F.desc(F.round(score, 12)), *(F.col(f"e_{c}" if c in EVIDENCE else c) for c in PLACE)]


def semantic_matches(claims: DataFrame, edges: DataFrame, k: int = TOP_K) -> DataFrame:
    """``(claim_id, similarity, predicate, chunk_text, source_file, chunk_index, rank)``: the ``k`` edges between a claim's ends whose
    predicates are nearest to the claim's."""
    asked = claims.where("predicate_vector is not null").select("claim_id", normalized(F.col("subject")).alias("src_norm"), normalized(F.col("obj")).alias("dst_norm"), "predicate_vector")
    found = _scored(asked, edges, ["src_norm", "dst_norm"])
    rank = F.row_number().over(Window.partitionBy("claim_id").orderBy(*_best(F.col("similarity"))))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("claim_id", "similarity", *(F.col(f"e_{c}").alias(c) for c in EVIDENCE), "rank")


def partial_matches(specs: DataFrame, edges: DataFrame, k: int = TOP_K, pool: int = POOL) -> DataFrame:
    """Edges that fit partial triples: ``(spec_id, subject, predicate, obj, chunk_text, source_file, chunk_index, similarity, rank)``.

    ``specs(spec_id, subject, obj, predicate_vector)``, nulls for what is unknown. Each pattern of nulls is its own equi-join, so
    no join is a scan of pairs; specs without any end share the first edges of the graph. The first ``pool`` edges by place are ranked by
    cosine, or keep their order at similarity 0 where the predicate is unknown; names are display names.
    """
    asked = specs.select("spec_id", normalized(F.col("subject")).alias("qs"), normalized(F.col("obj")).alias("qo"), "predicate_vector")
    s, o = F.col("qs").isNotNull(), F.col("qo").isNotNull()
    narrow = edges.select(*PLACE, "chunk_text", "predicate_embedding", "edge_norm", "src_name", "dst_name")

    def joined(rows: DataFrame, on: dict[str, str]) -> DataFrame:
        """Specs with the first edges of their ends: those are ranked by end before the join, so a spec meets ``pool`` at most."""
        keys = list(on.values())
        keyed = rows.withColumnsRenamed(on).drop(*({"qs", "qo"} - set(on)))
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*PLACE))
        first = narrow.join(keyed.select(*keys).distinct(), keys, "left_semi").withColumn("_at", place).where(F.col("_at") <= pool)
        return keyed.join(first, keys)

    cases = [(s & o, {"qs": "src_norm", "qo": "dst_norm"}), (s & ~o, {"qs": "src_norm"}), (~s & o, {"qo": "dst_norm"})]
    found = None
    for condition, on in cases:
        part = joined(asked.where(condition), on)
        found = part if found is None else found.unionByName(part)
    # a spec without ends takes the first edges of the graph: they are the same ``pool`` rows for all such specs
    head = narrow.orderBy(*PLACE).limit(pool).withColumn("_at", F.row_number().over(Window.orderBy(*PLACE)))
    pooled = found.unionByName(asked.where(~s & ~o).drop("qs", "qo").join(F.broadcast(head)))
    known = F.col("predicate_vector").isNotNull()
    value = F.when(known & F.col("edge_norm").isNotNull(), cosine(F.col("predicate_vector"), F.col("predicate_embedding"), None, F.col("edge_norm"))).when(~known, 0.0)
    scored = pooled.withColumn("similarity", value).where("similarity is not null")
    rank = F.row_number().over(Window.partitionBy("spec_id").orderBy(F.desc(F.round("similarity", 12)), "_at"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("spec_id", F.col("src_name").alias("subject"), "predicate", F.col("dst_name").alias("obj"), "chunk_text", "source_file", "chunk_index", "similarity", "rank")


def with_names(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with the display names of their ends."""
    a, b = (entities.select(F.col("normalized_name").alias(k), F.col("name").alias(n)) for k, n in (("src_norm", "src_name"), ("dst_norm", "dst_name")))
    return edges.join(a, "src_norm").join(b, "dst_norm")


RESULT = ("claim_id", "claim", "subject", "predicate", "obj", "match_type", "similarity", "source_chunk", "source_file", "chunk_index", "verified", "is_question", "answer_field")


def attribute_claims(claims: DataFrame, edges: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per claim: exact match, else the nearest predicate between the same ends, else not found.

    A claim without a triple is a parse error. The nearest predicate below ``threshold`` gives its similarity but no source.
    Only claims without an exact match are compared with vectors.
    """
    exact = exact_matches(claims, edges)
    rest = claims.join(exact.select("claim_id"), "claim_id", "left_anti")
    near = semantic_matches(rest, edges, 1).select("claim_id", "similarity", F.struct(*EVIDENCE).alias("near"))
    ok = F.col("similarity") >= threshold
    source = F.when(F.col("hit").isNotNull(), F.col("hit")).when(ok, F.col("near"))
    parsed = F.col("subject").isNotNull() & F.col("predicate").isNotNull() & F.col("obj").isNotNull()
    joined = claims.join(exact, "claim_id", "left").join(near, "claim_id", "left")
    return joined.select(
        "claim_id", "claim", *(F.coalesce(c, F.lit("")).alias(c) for c in ("subject", "predicate", "obj")),
        F.when(~parsed, "parse_error").when(F.col("hit").isNotNull(), "exact").when(ok, "semantic").otherwise("not_found").alias("match_type"),
        F.when(F.col("hit").isNotNull(), 1.0).otherwise(F.coalesce("similarity", F.lit(0.0))).alias("similarity"),
        F.coalesce(source["chunk_text"], F.lit("")).alias("source_chunk"), F.coalesce(source["source_file"], F.lit("")).alias("source_file"), F.coalesce(source["chunk_index"], F.lit(0)).alias("chunk_index"),
        F.coalesce(F.col("hit").isNotNull() | ok, F.lit(False)).alias("verified"), F.lit(False).alias("is_question"), F.lit("").alias("answer_field"),
    )


def attribute_questions(specs: DataFrame, edges: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per question ``(claim_id, claim, subject, predicate, obj, predicate_vector)``, slots null where unknown.

    No known slot is a parse error. With an unknown predicate the first fitting edge is the answer, similarity 1. Below ``threshold`` a
    question is not found but still shows the best candidate.
    """
    spec = F.struct("subject", "predicate", F.col("obj").alias("object"))
    known, _, unknown = slot_facts(spec)
    asked = specs.withColumns({"_known": known, "_unknown": F.coalesce(unknown, F.lit(""))})
    best = partial_matches(asked.where("_known > 0").select(F.col("claim_id").alias("spec_id"), "subject", "obj", "predicate_vector"), edges, 1)
    best = best.select(F.col("spec_id").alias("claim_id"), F.struct("subject", "predicate", "obj", "chunk_text", "source_file", "chunk_index", "similarity").alias("b"))
    free = F.col("predicate").isNull()
    ok = F.col("b").isNotNull() & (free | (F.col("b.similarity") >= threshold))
    joined = asked.join(best, "claim_id", "left")
    return joined.select(
        "claim_id", "claim", *(F.coalesce(F.col(f"b.{c}"), F.col(c), F.lit("")).alias(c) for c in ("subject", "predicate", "obj")),
        F.when(F.col("_known") == 0, "parse_error").when(ok, "semantic").otherwise("not_found").alias("match_type"),
        F.when(F.col("b").isNotNull() & free, 1.0).otherwise(F.coalesce("b.similarity", F.lit(0.0))).alias("similarity"),
        F.coalesce("b.chunk_text", F.lit("")).alias("source_chunk"), F.coalesce("b.source_file", F.lit("")).alias("source_file"), F.coalesce("b.chunk_index", F.lit(0)).alias("chunk_index"),
        F.coalesce(ok, F.lit(False)).alias("verified"), F.lit(True).alias("is_question"), F.col("_unknown").alias("answer_field"),
    )


def first_triples(claims: DataFrame, beams: str = "beams") -> DataFrame:
    """Claims in words with the ``subject, predicate, obj`` that a model's markup ``beams`` say first: the first triple of the first beam that
    has one. Without any the three are null, which attribution tells as a parse error."""
    every = F.flatten(F.transform(F.coalesce(beams, F.array().cast("array<string>")), triples_of))
    first = F.get(every, F.lit(0))
    return claims.withColumn("_first", first).withColumns({"subject": F.col("_first.subject"), "predicate": F.col("_first.predicate"), "obj": F.col("_first.object")}).drop("_first", beams)


def attribute_texts(texts: DataFrame, edges: DataFrame, model: TripleModel, embedder: Embedder, threshold: float = THRESHOLD) -> DataFrame:
    """Verdicts on claims in words, ``texts(claim_id, claim)``: the model's first triple, its predicate's vector, then the cascade. Texts that look like
    questions have a path of their own (see :func:`attribute`) and are left out."""
    claims = routed(texts).where("not is_question").drop("is_question")
    read = first_triples(claims.withColumn("beams", column(model.beams, "array<string>", F.col("claim"), 16)))
    vector = F.when(F.col("predicate").isNotNull(), column(embedder.encode, "array<float>", F.coalesce("predicate", F.lit(""))))
    return attribute_claims(read.withColumn("predicate_vector", vector), edges, threshold)


def routed(texts: DataFrame, text: str = "claim") -> DataFrame:
    """Texts stripped, with ``is_question``."""
    return texts.withColumn(text, strip(F.col(text))).withColumn("is_question", is_question(F.col(text)))


def parsed_questions(questions: DataFrame, raw: str = "raw") -> DataFrame:
    """Questions with ``subject, predicate, obj`` of the model's raw answer."""
    spec = slots(F.col(raw))
    return questions.withColumns({"subject": spec["subject"], "predicate": spec["predicate"], "obj": spec["object"]})


def attribute(inputs: DataFrame, edges: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Claims and questions of one batch, each down its own path: ``inputs`` has the columns of both and ``is_question``."""
    claims = attribute_claims(inputs.where("not is_question").drop("is_question"), edges, threshold)
    return claims.unionByName(attribute_questions(inputs.where("is_question").drop("is_question"), edges, threshold)).select(*RESULT)
