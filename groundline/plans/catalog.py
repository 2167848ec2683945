"""The named queries over the star schema and the document tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundline import providers
from groundline.functions import markup, scores, text
from groundline.operators import attribution, audit, graph, render, vectors
from groundline.operators.components import components
from groundline.plans import prompts
from groundline.plans.oracles import ORACLE_SQL
from groundline.sources import files
from groundline.sources.store import GraphStore
from groundline.sources.tables import table
from groundline.streaming import stop_tag

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Threshold under which the made-up vectors form clusters; the operators' own default is 0.90.
CLUSTER_AT = 0.40
PREDICATES = ("located in", "Based In", "registered in", "part of")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------- text

@query
def word_chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return text.chunked(docs, text.word_windows(F.col("text")))


@query
def char_chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    each = text.chunked(docs, text.char_windows(F.col("text")))
    return each.withColumn("chunk_id", text.chunk_id(F.col("doc_id").cast("string"), F.col("chunk_index"))).withColumn("source_id", text.source_id(F.col("doc_id").cast("string"), F.col("chunk_index")))


@query
def sentence_rows(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence"))


@query
def fact_rows(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.atomic_facts(F.col("text"))).alias("pos", "fact"))


@query
def row_render(spark, d):
    p = table(spark, d, "part")
    c = {k: text.cleaned(F.when(F.col("p_partkey") % m == 0, F.lit(bad)).otherwise(F.col(k).cast("string"))) for k, m, bad in (("p_brand", 5, " NaN "), ("p_type", 7, None), ("p_size", 3, "none"))}
    out = text.rendered([{"Type": c["p_type"], "Size": c["p_size"]}, {"Brand": c["p_brand"]}], [("Synopsis", F.col("p_name"), ""), ("Tags", c["p_type"], ".")], F.col("p_name"), [("Other Title", c["p_brand"])])
    return p.select("p_partkey", out.alias("text"), F.length(out).alias("n")).where("n >= 20")


@query
def dataset_articles(spark, d):
    return files.articles(table(spark, d, "benchmark"), F.col("item_id"))


@query
def file_dispatch(spark, d):
    path = F.concat(F.col("source"), F.lit("/f"), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, (".txt", ".PDF", ".md", ".docx", ""))), (F.pmod("doc_id", F.lit(5)) + 1).cast("int")))
    return table(spark, d, "documents").select("doc_id", path.alias("path"), F.coalesce(files.file_kind(path), F.lit("unsupported")).alias("kind"))


@query
def question_route(spark, d):
    turn = F.pmod("turn", F.lit(4))
    said = F.when(turn == 0, F.concat(F.lit("Who "), "text")).when(turn == 1, F.concat("text", F.lit("? "))).when(turn == 2, F.concat(F.lit("  CHI "), "text")).otherwise(F.col("text"))
    return attribution.routed(table(spark, d, "conversations").select("conv_id", "turn", said.alias("claim"))).select("conv_id", "turn", F.length("claim").alias("n"), "is_question")


def _raw_slots(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    raw = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit('ok {"subject": "?", "predicate": "located in", "object": " '), "n_name", F.lit(' "} x'))).when(F.col("c_custkey") % 4 == 1, F.lit('{"subject": {"a": 1}}'))
    raw = raw.when(F.col("c_custkey") % 4 == 2, F.concat(F.lit('{"subject": "'), "c_name", F.lit('", "predicate": "based in", "object": "'), "n_name", F.lit('"}'))).otherwise(F.lit("no json"))
    return c.select("c_custkey", raw.alias("raw"))


@query
def slot_parse(spark, d):
    found = attribution.parsed_questions(_raw_slots(spark, d))
    known, complete, unknown = text.slot_facts(F.struct("subject", "predicate", F.col("obj").alias("object")))
    return found.select("c_custkey", "subject", "predicate", "obj", known.alias("known"), complete.alias("complete"), unknown.alias("unknown"))


@query
def question_prompts(spark, d):
    asked = table(spark, d, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", prompts.question_slots(F.col("text")).alias("prompt"), F.length(prompts.initial(F.col("text"))).alias("n_initial"))


@query
def resume_prompts(spark, d):
    """Each run's sources as a numbered list."""
    t = table(spark, d, "conversations")
    held = t.where("role <> 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("source"), F.col("text").alias("document")))).alias("s"))
    return held.select("conv_id", prompts.source_list(F.col("s")).alias("sources"))


@query
def markup_triples(spark, d):
    """Two beams a customer, the second a case-changed copy and one triple more."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    one = F.concat(F.lit("<s><triplet> "), "c_name", F.lit(" <subj> "), "n_name", F.lit(" <obj> located in <subj> "), "c_mktsegment", F.lit(" <obj> works in</s><pad>"))
    two = F.concat(F.lit("tp_XX<triplet> "), F.upper("c_name"), F.lit("<per>"), F.lower("n_name"), F.lit("<loc>Located In<relation> "), "n_name", F.lit(" <> region "), F.col("n_regionkey").cast("string"), F.lit(" <loc> part of"))
    return markup.extracted(c.select(F.lit("customer").alias("source_file"), F.col("c_custkey").alias("chunk_index"), F.array(one, two).alias("beams")))


# ---------------------------------------------------------------- graph

def _triples(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    kind = lambda k: F.element_at(F.array(*map(F.lit, PREDICATES[:3])), (F.pmod(k, F.lit(3)) + 1).cast("int"))
    rows = []
    for t, key, name, at in (("customer", "c_custkey", "c_name", "c_nationkey"), ("supplier", "s_suppkey", "s_name", "s_nationkey")):
        rows.append(table(spark, d, t).join(n, F.col(at) == F.col("n_nationkey")).select(F.col(name).alias("subject"), kind(key).alias("predicate"), F.col("n_name").alias("obj"), F.lit(t).alias("source_file"), F.col(key).cast("int").alias("chunk_index"), F.pmod(key, F.lit(3)).cast("long").alias("vec_id")))
    rows.append(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("subject"), F.lit("part of").alias("predicate"), F.col("r_name").alias("obj"), F.lit("nation").alias("source_file"), F.col("n_nationkey").cast("int").alias("chunk_index"), F.lit(3).cast("long").alias("vec_id")))
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    chunk = F.concat_ws(" ", "subject", "predicate", "obj")
    return every.withColumn("chunk_text", chunk).join(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("predicate_embedding")), "vec_id").drop("vec_id")


def _order():
    return [F.col(c) for c in ("source_file", "chunk_index", "predicate", "subject", "obj")]


def _graph(spark, d):
    triples = _triples(spark, d)
    entities = graph.mentions(triples, _order())
    return entities, graph.edges_of(triples)


def _edges(spark, d):
    return attribution.with_norms(_graph(spark, d)[1])


@query
def entity_upsert(spark, d):
    """Nations are known under other names; customers and suppliers are new."""
    known = table(spark, d, "nation").select(text.normalized(F.col("n_name")).alias("normalized_name"), F.concat(F.lit("Land "), "n_name").alias("name"))
    return graph.upsert_entities(known, _triples(spark, d), _order())


@query
def edge_append(spark, d):
    return graph.edges_of(_triples(spark, d)).select("src_norm", "dst_norm", "predicate", "chunk_text", "source_file", "chunk_index", F.size("predicate_embedding").alias("n_dims"))


@query
def edge_replace(spark, d):
    """The supplier file comes again with other text."""
    fresh = graph.edges_of(_triples(spark, d).where("source_file = 'supplier'").withColumn("chunk_text", F.upper("chunk_text")))
    return graph.replace_source(_graph(spark, d)[1], fresh).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_text").alias("first_chunk"))


@query
def graph_stats(spark, d):
    return graph.stats(*_graph(spark, d))


@query
def doc_catalog(spark, d):
    """A catalog of sources, some of which come again later."""
    docs = table(spark, d, "documents").select(F.col("source").alias("name"), F.size(text.word_windows(F.col("text"))).alias("chunks"), F.size(text.sentences(F.col("text"))).alias("triples"), "lang")
    made = lambda df, at, status: df.groupBy("name").agg(F.sum("chunks").alias("num_chunks"), F.sum("triples").alias("num_triples")).select("name", F.to_timestamp(F.lit(at)).alias("ingested_at"), "num_chunks", "num_triples", F.lit(status).alias("status"))
    return graph.upsert_documents(made(docs, "2024-01-01 00:00:00", "done"), made(docs.where("lang = 'es'"), "2024-02-01 00:00:00", "error")).drop("ingested_at")


@query
def ingest_totals(spark, d):
    docs = table(spark, d, "documents").withColumn("source_file", F.col("doc_id").cast("string"))
    each = text.chunked(docs.select("source_file", "text"), text.word_windows(F.col("text")))
    facts = docs.select("source_file", F.explode(text.sentences(F.col("text"))))
    return graph.ingest_totals(each, facts, docs.where("lang = 'fr'"))


@query
def doc_newest(spark, d):
    """The catalog, newest first, as places: each source was ingested at its own time."""
    docs = table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("num_chunks"), F.min("doc_id").alias("n"))
    rows = docs.select("name", F.timestamp_seconds(F.pmod(F.col("n") * 7919, F.lit(1000))).alias("ingested_at"), "num_chunks", F.lit(0).cast("long").alias("num_triples"), F.lit("done").alias("status"))
    return graph.document_list(rows).withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))).select("name", "num_chunks", "place")


@query
def entity_scan(spark, d):
    """Entities of a store that was written in two minibatches and read again, with how many edges begin at each."""
    store = _stored(spark, d)
    n = store.table("edges").groupBy(F.col("src_norm").alias("normalized_name")).agg(F.count(F.lit(1)).alias("n"))
    return store.table("entities").join(n, "normalized_name", "left").select("normalized_name", "name", F.coalesce("n", F.lit(0)).alias("n_edges"))


@query
def ingest_status(spark, d):
    """Documents of a store after an ingest that was done and one that failed."""
    store = _stored(spark, d)
    return store.table("documents").select("name", "num_chunks", "num_triples", "status")


@query
def graph_cleared(spark, d):
    """Rows of each table after a store was emptied, and before."""
    store = _stored(spark, d)
    before = store.stats()
    store.clear()
    after = store.stats()
    return spark.createDataFrame([("before", before["nodes"], before["relations"]), ("after", after["nodes"], after["relations"])], "state string, nodes long, relations long")


@query
def ingest_streamed(spark, d):
    """Chunks as a stream of minibatches of 16 through the pattern extractor into a store: its edges."""
    from groundline.sources.scratch import scratch_path, written
    from groundline.streaming.ingest import ingest_stream

    t = _triples(spark, d).select(F.concat_ws(" -- ", "subject", "predicate", "obj").alias("text"), "source_file", "chunk_index")
    chunks = written(t, "ingest-chunks")
    store = GraphStore(spark, scratch_path(spark, "ingest-graph"))
    stream = spark.readStream.schema(chunks.schema).parquet(chunks.inputFiles()[0].rsplit("/", 1)[0])
    ingest_stream(stream, store, scratch_path(spark, "ingest-checkpoint"), model=providers.PatternTriples()).awaitTermination(600)
    return store.table("edges").select("src_norm", "dst_norm", "predicate", "chunk_text", "source_file", "chunk_index")


def _stored(spark, d):
    from groundline.sources.scratch import scratch_path

    store, t = GraphStore(spark, scratch_path(spark, "graph")), _triples(spark, d)
    store.ingest(t.where("source_file = 'nation'"), "nation", 25)
    store.ingest(t.where("source_file = 'supplier'"), "supplier", 7)
    try:
        store.ingest(t.where("source_file = 'supplier'").withColumn("subject", F.raise_error(F.lit("a model failed")).cast("string")), "customer", 3)
    except Exception:  # noqa: BLE001, S110 - the store has noted it
        pass
    return store


@query
def vector_upsert(spark, d):
    """Half of a collection of chunks comes again, in two versions of which the last counts."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("title"), "text")
    rows = text.chunked(docs, text.char_windows(F.col("text"))).select(text.chunk_id(F.col("title"), F.col("chunk_index")).alias("id"), F.col("text").alias("document"), F.lit(0).alias("version"))
    again = rows.where("id < '8'")
    fresh = again.withColumn("version", F.lit(1)).unionByName(again.withColumns({"version": F.lit(2), "document": F.concat(F.lit("new "), "document")}))
    return graph.upsert_vectors(rows, fresh, ["version"])


# ---------------------------------------------------------------- attribution

def _claims(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("kind", F.pmod("c_custkey", F.lit(5)))
    k, own = F.col("kind"), F.element_at(F.array(*map(F.lit, PREDICATES[:3])), (F.pmod("c_custkey", F.lit(3)) + 1).cast("int"))
    predicate = F.when(k == 0, F.upper(own)).when(k == 1, "sits in").when(k == 2, "far from").when(k == 3, own)
    vec = F.when(k == 1, F.pmod("c_custkey", F.lit(3))).otherwise(F.lit(10)).cast("long")
    rows = c.select(
        F.col("c_custkey").alias("claim_id"), F.concat_ws(" ", "c_name", F.lit("is somewhere")).alias("claim"), F.when(k < 4, F.concat(F.lit("  "), F.upper("c_name"), F.lit(" "))).alias("subject"), predicate.alias("predicate"),
        F.when(k == 3, "NOWHERE").when(k < 3, F.col("n_name")).alias("obj"), vec.alias("vec_id"),
    )
    return rows.join(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("predicate_vector")), "vec_id").drop("vec_id")


@query
def attr_exact(spark, d):
    return attribution.exact_matches(_claims(spark, d), _edges(spark, d)).select("claim_id", "hit.*")


def _read_claims(spark, d):
    """Claims in words as a model reads them: two beams, of which the first may say nothing."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    said = F.concat(F.lit("<triplet> "), "c_name", F.lit(" <subj> "), "n_name", F.lit(" <obj> located in"))
    beams = F.when(F.pmod("c_custkey", F.lit(3)) == 0, F.array(said, F.lit("<triplet> x <subj> y <obj> z"))).when(F.pmod("c_custkey", F.lit(3)) == 1, F.array(F.lit("nothing"), said)).otherwise(F.array(F.lit("<triplet> cut <subj> short")))
    return c.select(F.col("c_custkey").alias("claim_id"), F.concat("c_name", F.lit(" lives there")).alias("claim"), beams.alias("beams"), F.lit(None).cast("array<float>").alias("predicate_vector"))


@query
def claim_triples(spark, d):
    """The first triple of each claim in words."""
    return attribution.first_triples(_read_claims(spark, d)).drop("predicate_vector")


@query
def claim_verdicts(spark, d):
    """Claims in words down to their verdict: those without a triple are parse errors."""
    return attribution.attribute_claims(attribution.first_triples(_read_claims(spark, d)), _edges(spark, d))


@query
def attr_semantic(spark, d):
    return attribution.semantic_matches(_claims(spark, d), _edges(spark, d)).withColumn("similarity", r6("similarity"))


@query
def attr_cascade(spark, d):
    return attribution.attribute_claims(_claims(spark, d), _edges(spark, d)).withColumn("similarity", r6("similarity"))


def _named_edges(spark, d):
    entities, edges = _graph(spark, d)
    return attribution.with_norms(attribution.with_names(edges, entities))


def _vector(spark, d, vec):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("_v"), F.col("embedding").alias("predicate_vector")).where(F.col("_v") == vec).drop("_v")


def _specs(spark, d, rows, vec):
    return rows.crossJoin(F.broadcast(_vector(spark, d, vec)))  # one vector


@query
def partial_subject(spark, d):
    """(?, located in, nation) for every nation."""
    specs = _specs(spark, d, table(spark, d, "nation").select(F.col("n_nationkey").alias("spec_id"), F.lit(None).cast("string").alias("subject"), F.col("n_name").alias("obj")), 0)
    return attribution.partial_matches(specs, _named_edges(spark, d)).withColumn("similarity", r6("similarity"))


@query
def partial_object(spark, d):
    """(customer, based in, ?) for every customer."""
    specs = _specs(spark, d, table(spark, d, "customer").select(F.col("c_custkey").alias("spec_id"), F.col("c_name").alias("subject"), F.lit(None).cast("string").alias("obj")), 1)
    return attribution.partial_matches(specs, _named_edges(spark, d)).withColumn("similarity", r6("similarity"))


@query
def partial_both(spark, d):
    """(supplier, ?, nation): the predicate is unknown."""
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    specs = rows.select(F.col("s_suppkey").alias("spec_id"), F.col("s_name").alias("subject"), F.col("n_name").alias("obj"), F.lit(None).cast("array<float>").alias("predicate_vector"))
    return attribution.partial_matches(specs, _named_edges(spark, d)).withColumn("similarity", r6("similarity"))


@query
def partial_predicate(spark, d):
    """(?, part of, ?): ranked among the first edges of the graph."""
    specs = _specs(spark, d, spark.range(1).select(F.col("id").alias("spec_id"), F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("obj")), 3)
    return attribution.partial_matches(specs, _named_edges(spark, d)).withColumn("similarity", r6("similarity"))


@query
def attr_questions(spark, d):
    """Questions of every customer: where it is located, what it is to its nation, and nothing at all."""
    k = F.pmod("c_custkey", F.lit(4))
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(F.col("c_custkey").alias("claim_id"), F.concat(F.lit("where is "), "c_name").alias("claim"), F.when(k < 3, F.col("c_name")).alias("subject"), F.when((k == 0) | (k == 2), "located in").alias("predicate"), F.when(k == 1, F.col("n_name")).when(k == 2, "NOWHERE").alias("obj"))
    specs = _specs(spark, d, rows, 0).withColumn("predicate_vector", F.when(F.col("predicate").isNotNull(), F.col("predicate_vector")))
    return attribution.attribute_questions(specs, _named_edges(spark, d)).withColumn("similarity", r6("similarity"))


@query
def attr_mixed(spark, d):
    """Claims and questions in one batch."""
    claims = _claims(spark, d).withColumn("is_question", F.lit(False))
    asked = table(spark, d, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("claim_id"), F.concat(F.lit("Where is "), "s_name", F.lit("?")).alias("claim"), F.col("s_name").alias("subject"), F.lit(None).cast("string").alias("predicate"), F.lit(None).cast("string").alias("obj"), F.lit(None).cast("array<float>").alias("predicate_vector"))
    both = claims.unionByName(attribution.routed(asked))
    return attribution.attribute(both, _named_edges(spark, d)).groupBy("is_question", "match_type", "verified", "answer_field").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(r6("similarity"))).alias("similarity"))


# ---------------------------------------------------------------- vectors

def _asked(df: DataFrame, key: str) -> DataFrame:
    """The stated query set: ids divisible by 100."""
    return df.where(F.col(key) % 100 == 0)


@query
def knn_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = _asked(e, "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vectors.nearest(q, e.select(F.col("vec_id").alias("vector_id"), F.col("embedding").alias("vector"))).withColumn("distance", r6("distance"))


@query
def token_similarity(spark, d):
    """Greedy token similarity of embeddings taken four at a time, each against the next four."""
    e = table(spark, d, "embeddings").select(F.expr("vec_id div 4").alias("g"), "vec_id", "embedding").groupBy("g").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("t"))
    e = e.select("g", F.transform("t", lambda x: x["embedding"]).alias("tokens"))
    both = e.join(e.select((F.col("g") - 1).alias("g"), F.col("tokens").alias("other")), "g")
    return both.select("g", scores.greedy_similarity(F.col("tokens"), F.col("other")).alias("s")).select("g", *(r6(f"s.{c}").alias(c) for c in ("precision", "recall", "f1")))


@query
def hybrid_rerank(spark, d):
    e = table(spark, d, "embeddings").join(table(spark, d, "documents"), F.col("vec_id") == F.col("doc_id"))
    q = _asked(e, "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("text").alias("query_text"))
    found = vectors.hybrid(q, e.select(F.col("vec_id").alias("vector_id"), F.col("embedding").alias("vector"), F.col("text").alias("document")))
    return found.withColumns({c: r6(c) for c in ("distance", "hybrid_score")})


def _entity_vectors(spark, d):
    name = F.concat(F.lit("Name"), F.substring(F.lit("abcdefg"), F.lit(1), F.pmod("vec_id", F.lit(7)).cast("int")), F.col("vec_id").cast("string"))
    return table(spark, d, "embeddings").select(F.lower(name).alias("normalized_name"), name.alias("name"), "vec_id", "embedding")


def _pairs(spark, d):
    return vectors.near_pairs(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), CLUSTER_AT)


@query
def cluster_pairs(spark, d):
    return _pairs(spark, d).withColumn("similarity", r6("similarity"))


def _labels(spark, d):
    found = components(_pairs(spark, d).select("a", "b"), "entity")
    least = found.groupBy("label").agg(F.min("node").alias("least"))
    return table(spark, d, "embeddings").select("vec_id").join(found.join(least, "label").select(F.col("node").alias("vec_id"), "least"), "vec_id", "left").select("vec_id", F.coalesce("least", "vec_id").alias("label"))


@query
def cluster_labels(spark, d):
    return _labels(spark, d)


def _canon(spark, d):
    v = _entity_vectors(spark, d)
    return graph.canonical_names(v.select("normalized_name", "name"), _labels(spark, d).join(v, "vec_id").select("normalized_name", "label"))


@query
def cluster_canonical(spark, d):
    return _canon(spark, d)


def _ring(spark, d):
    """Edges among the entities: a few along fixed steps, and loops."""
    v = _entity_vectors(spark, d).select("vec_id", "normalized_name")
    n = v.count()
    step = v.select("vec_id", F.col("normalized_name").alias("src_norm"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(7))).alias("s"))
    to = step.withColumn("to", F.when(F.col("s") == 0, F.col("vec_id")).otherwise(F.pmod(F.col("vec_id") * F.col("s") + 3, F.lit(n)))).join(v.select(F.col("vec_id").alias("to"), F.col("normalized_name").alias("dst_norm")), "to")
    return to.select("src_norm", "dst_norm", F.concat(F.lit("step "), F.col("s").cast("string")).alias("predicate"))


@query
def graph_after_merge(spark, d):
    v = _entity_vectors(spark, d).select("normalized_name", "name")
    entities, edges = graph.merge_entities(v, _ring(spark, d), _canon(spark, d))
    return edges.unionByName(entities.select(F.col("normalized_name").alias("src_norm"), F.lit("").alias("dst_norm"), F.lit("entity").alias("predicate")))


# ---------------------------------------------------------------- audit

def _runs(spark, d):
    """Each conversation is a run: what the assistant said, against all other turns."""
    t = table(spark, d, "conversations")
    said = t.where("role = 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")).select(F.col("conv_id").alias("run_id"), F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("response"))
    other = t.where("role <> 'assistant'").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("doc_idx"), F.col("text").alias("document"), F.col("role").alias("source"), F.col("turn").cast("int").alias("chunk_index"))
    return said, audit.facts_of(said), audit.evidence_of(other)


@query
def lexical_cells(spark, d):
    _, facts, evidence = _runs(spark, d)
    return audit.cells(facts, evidence, stemmed=False).withColumns({c: r6(c) for c in ("rouge_l", "score")})


@query
def rouge_stemmed(spark, d):
    _, facts, evidence = _runs(spark, d)
    return audit.cells(facts, evidence).withColumns({c: r6(c) for c in ("rouge_l", "score")})


@query
def support_best(spark, d):
    _, facts, evidence = _runs(spark, d)
    matrix = audit.cells(facts, evidence, stemmed=False).withColumns({c: r6(c) for c in ("rouge_l", "score")})
    return audit.best_evidence(facts, evidence, matrix)


@query
def support_overall(spark, d):
    runs, facts, evidence = _runs(spark, d)
    found = audit.overall(runs, audit.fact_scores(facts, audit.cells(facts, evidence, stemmed=False)))
    return found.withColumn("overall_score", F.round("overall_score", 5)).withColumn("level", scores.level(F.col("overall_score")))


@query
def support_report(spark, d):
    runs, facts, evidence = _runs(spark, d)
    matrix = audit.cells(facts, evidence)
    return audit.report(facts, evidence, matrix, audit.best_evidence(facts, evidence, matrix), audit.overall(runs, audit.fact_scores(facts, matrix)))


@query
def support_lists(spark, d):
    """What the report of the unstemmed matrix holds, read back from its JSON: facts, sentences, numbers of cells, results and the largest score."""
    runs, facts, evidence = _runs(spark, d)
    matrix = audit.cells(facts, evidence, stemmed=False).withColumns({c: r6(c) for c in ("rouge_l", "score")})
    told = audit.report(facts, evidence, matrix, audit.best_evidence(facts, evidence, matrix), audit.overall(runs, audit.fact_scores(facts, matrix)))
    shape = "atomic_facts array<string>, evidence_sentences array<string>, matrix array<array<double>>, attribution_results array<struct<fact:string,support_score:double>>, overall_score double"
    r = told.select("run_id", F.from_json("report", shape).alias("r"))
    cells = F.flatten("r.matrix")
    return r.select(
        "run_id", F.array_join("r.atomic_facts", "|").alias("facts"), F.array_join("r.evidence_sentences", "|").alias("sentences"), F.size(cells).alias("n_cells"), F.coalesce(F.array_max(cells), F.lit(0.0)).alias("largest"),
        F.array_join(F.transform("r.attribution_results", lambda x: x["fact"]), "|").alias("result_facts"), F.round("r.overall_score", 5).alias("overall_score"),
    )


@query
def response_html(spark, d):
    runs, facts, evidence = _runs(spark, d)
    matrix = audit.cells(facts, evidence)
    return render.responses(audit.best_evidence(facts, evidence, matrix), audit.overall(runs, audit.fact_scores(facts, matrix)))


@query
def heat_map_html(spark, d):
    _, facts, evidence = _runs(spark, d)
    return render.heat_maps(facts, evidence, audit.cells(facts, evidence))


@query
def html_levels(spark, d):
    s = F.round(F.col("l_discount") * 10, 4)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scores.level(s).alias("level"), scores.alpha(s).alias("alpha"), render.percent(s).alias("percent"), render.background(s).alias("background"), render.border(s).alias("border"))


@query
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", text.escaped(F.col("html")).alias("escaped"), render.cut(F.col("html"), 400).alias("shown"))


# ---------------------------------------------------------------- generation

@query
def source_accumulate(spark, d):
    hits = table(spark, d, "events").select(F.col("user_id").alias("run_id"), (F.pmod("event_id", F.lit(3)) + 1).cast("int").alias("iteration"), F.col("event_id").alias("rank"), F.col("event_type").alias("source_id"), "value")
    return audit.accumulated(hits)


@query
def retrieval_counters(spark, d):
    return audit.counters(table(spark, d, "events").select(F.col("user_id").alias("run_id"), (F.pmod("event_id", F.lit(3)) + 1).cast("int").alias("iteration")))


@query
def stop_tags(spark, d):
    """Conversations as token streams: a user's turn begins a tag, the assistant's ends it."""
    t = table(spark, d, "conversations")
    said = F.when(F.col("role") == "user", F.concat("text", F.lit(" <CER"))).when(F.col("role") == "assistant", F.concat(F.lit("CA:  look up "), F.col("turn").cast("string"), F.lit(" > rest"))).otherwise(F.col("text"))
    return stop_tag.generations(t.select(F.col("conv_id").cast("string").alias("gen_id"), F.col("turn").cast("int").alias("seq"), said.alias("response"), F.lit(False).alias("done")))
