import pytest
from pyspark.sql import functions as F

from groundline.operators import attribution, audit, graph, vectors
from groundline.operators.components import components

V1, V2, V3 = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]


def unit(c):
    return [c, 0.0, (1 - c * c) ** 0.5]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("A", "born in", "B", V1, 0), ("A", "Born In", "B", V1, 1), ("A", "works at", "C", V2, 2), ("B", "part of", "C", V3, 3)]
    triples = spark.createDataFrame([(s, p, o, f"{s} {p} {o}", "f.txt", i, v) for s, p, o, v, i in rows], "subject string, predicate string, obj string, chunk_text string, source_file string, chunk_index int, predicate_embedding array<float>")
    order = [F.col(c) for c in ("source_file", "chunk_index")]
    return attribution.with_norms(attribution.with_names(graph.edges_of(triples), graph.mentions(triples, order)))


def claims(spark, *rows):
    return spark.createDataFrame([(i, "c", *r) for i, r in enumerate(rows)], "claim_id long, claim string, subject string, predicate string, obj string, predicate_vector array<float>")


def test_claims(spark, edges):
    asked = claims(spark, (" a ", "BORN IN", "b", V2), ("b", "born in", "a", V1), ("A", "was born at", "B", unit(0.8)), ("A", "was born at", "B", unit(0.7)), ("A", "x", "D", V1), (None, None, None, None))
    found = {r["claim_id"]: r for r in attribution.attribute_claims(asked, edges).collect()}
    got = {k: (r["match_type"], round(r["similarity"], 4), r["chunk_index"], bool(r["source_file"]), r["verified"]) for k, r in found.items()}
    assert got == {
        0: ("exact", 1.0, 0, True, True), 1: ("not_found", 0.0, 0, False, False), 2: ("semantic", 0.8, 0, True, True), 3: ("not_found", 0.7, 0, False, False), 4: ("not_found", 0.0, 0, False, False), 5: ("parse_error", 0.0, 0, False, False),
    }


def test_questions(spark, edges):
    asked = claims(spark, (None, "part of", "C", V3), ("A", None, "B", None), ("A", None, None, None), (None, None, None, None), ("A", "far", None, unit(0.1)), ("Z", None, None, None))
    found = {r["claim_id"]: r for r in attribution.attribute_questions(asked, edges).collect()}
    got = {k: (r["match_type"], r["answer_field"], r["subject"], r["obj"], r["verified"]) for k, r in found.items()}
    assert got[0] == ("semantic", "subject", "B", "C", True) and got[1] == ("semantic", "predicate", "A", "B", True) and got[2][:2] == ("semantic", "") and found[2]["similarity"] == 1.0
    assert got[3][0] == "parse_error" and got[4][0] == "not_found" and found[4]["source_file"] == "f.txt" and found[4]["answer_field"] == "object" and got[5] == ("not_found", "", "Z", "", False)


def test_joins_are_equi_joins(spark, edges):
    asked = claims(spark, ("A", "x", "B", V1))
    plan = attribution.attribute_claims(asked, edges)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_top_k_is_limited_before_the_shuffle(spark, edges):
    plan = attribution.semantic_matches(claims(spark, ("A", "x", "B", V1)), edges)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_upsert_and_stats(spark):
    triples = spark.createDataFrame([(" Bob ", "p", "bob", "f", 0), ("Ann", "p", "BOB", "f", 1)], "subject string, predicate string, obj string, source_file string, chunk_index int").withColumn("chunk_text", F.lit("t"))
    order = [F.col("source_file"), F.col("chunk_index")]
    known = spark.createDataFrame([("ann", "Ann the First")], "normalized_name string, name string")
    assert {tuple(r) for r in graph.upsert_entities(known, triples, order).collect()} == {("ann", "Ann the First"), ("bob", " Bob ")}
    assert tuple(graph.stats(known, graph.edges_of(triples).limit(0)).first()) == (1, 0)


def test_merge(spark):
    names = ["Cristiano Ronaldo", "CR7", "Ronaldo", "X"]
    entities = spark.createDataFrame([(n.lower(), n) for n in names], "normalized_name string, name string")
    labels = spark.createDataFrame([("cristiano ronaldo", 1), ("cr7", 1), ("ronaldo", 1), ("x", 2)], "normalized_name string, label int")
    canon = graph.canonical_names(entities, labels)
    assert {tuple(r) for r in canon.collect()} == {(n.lower(), "cristiano ronaldo") for n in names[:3]}
    pairs = [("cr7", "x"), ("cr7", "ronaldo"), ("cr7", "cristiano ronaldo"), ("cristiano ronaldo", "cr7"), ("cr7", "cr7"), ("cristiano ronaldo", "cristiano ronaldo"), ("x", "x")]
    left, moved = graph.merge_entities(entities, spark.createDataFrame(pairs, "src_norm string, dst_norm string"), canon)
    assert sorted(map(tuple, moved.collect())) == [("cristiano ronaldo", "cristiano ronaldo"), ("cristiano ronaldo", "x"), ("x", "x")]
    assert sorted(r["normalized_name"] for r in left.collect()) == ["cristiano ronaldo", "x"]


@pytest.mark.parametrize("block", [7, 4096])
def test_neighbours_in_blocks(spark, sf, block):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = {r["vec_id"]: r["embedding"] for r in e.collect()}
    small = e.where("vec_id < 60").select(F.col("vec_id").alias("vector_id"), F.col("embedding").alias("vector"))
    q = small.where("vector_id % 20 = 0").select(F.col("vector_id").alias("query_id"), F.col("vector").alias("query_vector"))
    found = {}
    for r in vectors.nearest(q, small, 3, block=block).orderBy("rank").collect():
        found.setdefault(r["query_id"], []).append(r["vector_id"])
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i in (0, 20, 40):
        want = sorted(range(60), key=lambda j: (round(1 - dot(rows[i], rows[j]) / (dot(rows[i], rows[i]) * dot(rows[j], rows[j])) ** 0.5, 12), j))[:3]
        assert found[i] == want
    pairs = {(r["a"], r["b"]) for r in vectors.near_pairs(small.select(F.col("vector_id").alias("id"), "vector"), 0.3, block=block).collect()}
    assert pairs == {(i, j) for i in range(60) for j in range(i + 1, 60) if dot(rows[i], rows[j]) / (dot(rows[i], rows[i]) * dot(rows[j], rows[j])) ** 0.5 >= 0.3}


def test_hybrid_scores(spark):
    v = spark.createDataFrame([(1, [0.6, 0.8], "Paris holds rivers"), (2, [-0.3, 0.954], "nothing")], "vector_id long, vector array<float>, document string")
    q = spark.createDataFrame([(0, [1.0, 0.0], "paris rivers the")], "query_id long, query_vector array<float>, query_text string")
    found = {r["vector_id"]: (round(r["hybrid_score"], 3), r["hits"], r["rank"]) for r in vectors.hybrid(q, v).collect()}
    assert found == {1: (1.6, 2, 1), 2: (0.0, 0, 2)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (None, 3)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(found) == 41 + 20 and len({found[i] for i in range(41)}) == 1 and len({found[i] for i in range(100, 120)}) == 1 and found[0] != found[100]


SCENARIOS = [
    ("concordant", "Paris is the capital of France", ["Paris is the capital and largest city of France.", "It is situated on the River Seine."], 0.8, "high"),  # 6 of 6 and 6 of 9 words
    ("similar", "Paris is the capital of France", ["Paris is the capital of France"], 1.0, "high"),
    ("different", "The sky looks very blue", ["Quantum physics describes subatomic behaviour"], 0.0, "none"),
    ("nothing", "Some fact without evidence", [], 0.0, "none"),
]


def test_audit(spark):
    facts = spark.createDataFrame([(n, 0, f) for n, f, *_ in SCENARIOS], "run_id string, fact_idx int, fact string")
    documents = spark.createDataFrame([(n, i, s, None, None) for n, _, e, *_ in SCENARIOS for i, s in enumerate(e)], "run_id string, doc_idx int, document string, source string, chunk_index int")
    evidence = audit.evidence_of(documents)
    assert {(r["source"], r["chunk_index"]) for r in evidence.collect()} == {("Unknown", -1)}
    matrix = audit.cells(facts, evidence)
    best = {r["run_id"]: r for r in audit.best_evidence(facts, evidence, matrix).collect()}
    for name, _, sentences, least, level in SCENARIOS:
        assert best[name]["support_score"] >= least and best[name]["level"] == level
        assert best[name]["best_evidence"] == (sentences[0] if sentences else "")
    runs = facts.select("run_id").union(spark.createDataFrame([("empty",)], "run_id string"))
    totals = {r["run_id"]: r["overall_score"] for r in audit.overall(runs, audit.fact_scores(facts, matrix)).collect()}
    assert totals["empty"] == totals["nothing"] == 0.0 and totals["similar"] == 1.0


def test_accumulation(spark):
    hits = spark.createDataFrame([(1, 1, 0, "a", "x"), (1, 1, 1, None, "y"), (1, 2, 0, "a", "z"), (1, 2, 1, None, "w"), (2, 1, 0, "a", "v")], "run_id int, iteration int, rank int, source_id string, document string")
    assert sorted((r["run_id"], r["document"]) for r in audit.accumulated(hits).collect()) == [(1, "x"), (1, "y"), (2, "v")]


def test_components_of_chains_take_few_tables(spark):
    from groundline.operators import components as module

    names = []
    kept = module.written
    module.written = lambda df, name: (names.append(name), kept(df, name))[1]
    try:
        chain = [(i, i + 1) for i in range(1000)] + [(5000 - i, 5001 - i) for i in range(300)] + [(9000, 9000 + i) for i in range(1, 50)] + [(8000, None), (None, 8001), (7000, 7000)]
        found = {r["node"]: r["label"] for r in module.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    finally:
        module.written = kept
    assert all(found[i] == 0 for i in range(1001)) and all(found[i] == 4701 for i in range(4701, 5002)) and all(found[i] == 9000 for i in range(9000, 9050)) and found[7000] == 7000
    assert len(names) <= 20
    assert module.components(spark.createDataFrame([], "a long, b long")).count() == 0
