import json
import os
import time

import pytest
from pyspark.sql import functions as F

from groundline import providers
from groundline.plans import orchestrate
from groundline.sources import files, scratch
from groundline.sources.store import GraphStore
from groundline.streaming import stop_tag
from groundline.streaming.ingest import ingest_stream


def triples(spark, *rows):
    return spark.createDataFrame([(s, p, o, "t", f, i) for s, p, o, f, i in rows], "subject string, predicate string, obj string, chunk_text string, source_file string, chunk_index int")


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one two \xff three")
    (tmp_path / "b.MD").write_text(" ".join(f"w{i}" for i in range(160)))
    (tmp_path / "c.pdf").write_bytes(b"page one|  |page three")
    (tmp_path / "d.docx").write_text("x")
    texts = files.read_texts(spark, str(tmp_path))
    assert {r["source_file"]: r["text"] for r in texts.collect()}["a.txt"] == "one two � three"
    pages = files.read_pages(spark, str(tmp_path), lambda b: b.decode().split("|"))
    rows = files.chunks_of(texts.unionByName(pages)).collect()
    assert sorted((r["source_file"], r["chunk_index"], r["page_num"]) for r in rows) == [("a.txt", 0, None), ("b.MD", 0, None), ("b.MD", 1, None), ("c.pdf", 0, 1), ("c.pdf", 1, 3)]
    with pytest.raises(Exception, match="unsupported file type"):
        spark.createDataFrame([("x/d.docx",)], "p string").select(files.checked_kind(F.col("p"))).collect()


def test_articles(spark):
    rows = spark.createDataFrame([(1, "t" * 150, "ctx", "ignored"), (2, "u", "", "x"), (3, "v", None, "x")], "id int, question string, context string, text string")
    assert [tuple(r) for r in files.articles(rows, F.col("id")).collect()] == [("t" * 100, "ctx")]
    plain = spark.createDataFrame([(5, "p"), (6, "q")], "id int, passage string")
    assert sorted(map(tuple, files.articles(plain, F.col("id")).collect())) == [("Doc_0", "p"), ("Doc_1", "q")]
    assert files.articles(plain, F.col("id"), 1).count() == 1


def test_structured_articles(spark):
    rows = spark.createDataFrame(
        [(0, "Monster", "Monster", "TV", "2004", "8.8", "nan", "A doctor saves a boy.", None), (1, "None", " X ", None, "", None, None, None, "drama"), (2, None, None, None, None, None, None, None, None)],
        "id int, `Main Title` string, `Official Title (en)` string, filter_type string, filter_year string, `Max Rating` string, Direction string, Synopsis string, processed_tags string",
    )
    found = {r["title"]: r["text"] for r in files.structured_articles(rows, F.col("id")).collect()}
    assert found == {"Monster": "Title: Monster. Type: TV. Year: 2004. Rating: 8.8/10. Synopsis: A doctor saves a boy.", "Anime_1": "Title: Anime_1. English Title: X. Tags: drama."}
    assert files.structured_articles(rows, F.col("id"), 1).count() == 1


def test_store(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    assert store.write_triples(triples(spark, ("A", "p", "B", "f", 0))) == 1
    store.ingest(triples(spark, ("a", "q", "C", "f", 1)), "f", 2)
    assert sorted(r["name"] for r in store.table("entities").collect()) == ["A", "B", "C"] and store.table("edges").count() == 2
    store.write_triples(triples(spark, ("A", "p", "B", "f", 0)), replace=True)
    assert store.table("edges").count() == 1
    with pytest.raises(Exception):  # noqa: B017
        store.ingest(triples(spark, ("A", "p", "B", "f", 0)).withColumn("subject", F.raise_error(F.lit("bad")).cast("string")), "g", 1)
    assert store.table("edges").count() == 1
    assert {r["name"]: (r["status"], r["num_triples"]) for r in store.table("documents").collect()} == {"f": ("done", 1), "g": ("error", 0)}
    store.write_document("", 1, 1, "done")
    assert store.table("documents").count() == 2
    store.clear()
    assert [store.table(t).count() for t in ("entities", "edges", "documents")] == [0, 0, 0]


def test_vector_collection(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "v"))
    embed = lambda t: providers.column(providers.HashingEmbedder(8, True).encode, "array<float>", t)
    arts = spark.createDataFrame([("t", "x" * 460), ("t", "y" * 10)], "title string, text string")
    assert not store.is_ready()
    store.ensure_vectors(lambda: files.vector_rows(arts, embed))
    assert store.is_ready() and store.table("vectors").count() == 2  # equal titles share ids
    assert tuple(store.write_vectors(files.vector_rows(arts, embed)).first()) == (3, 2)
    store.reset_vectors()
    assert not store.is_ready()


STREAMS = {
    "a": (["Let me ", "<CER", "CA: a b ", ">", "zz"], ("Let me", "a b", True)),
    "b": (["abc <CERCA: x"], ("abc", None, False)),
    "c": ([" plain "], (" plain ", None, False)),
    "d": (["x <CERCA: q > y <CERCA: r >"], ("x", "q", True)),
}


def tokens(spark):
    rows = [(g, i, t, i == len(ts) - 1 and g != "d") for g, (ts, _) in STREAMS.items() for i, t in enumerate(ts)]
    return spark.createDataFrame([*rows, ("a", 9, "after the end", False)], stop_tag.TOKENS)


def test_stop_tags(spark):
    assert {r["gen_id"]: (r["text"], r["query"], r["stopped"]) for r in stop_tag.generations(tokens(spark)).collect()} == {g: w for g, (_, w) in STREAMS.items()}


def streamed(spark, folder, files, name, n_wanted=0, **options):
    """Rows of the streaming detector over ``files`` of lines, one a minibatch."""
    (folder / "in").mkdir()
    for n, lines in enumerate(files):
        path = folder / "in" / f"{n:03d}.json"
        path.write_text("\n".join([*(x if isinstance(x, str) else json.dumps(x) for x in lines), "not json"]))
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = stop_tag.token_lines(spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(str(folder / "in")))
    writer = stop_tag.detected(stream, **options).writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / "cp"))
    if not options:
        assert writer.trigger(availableNow=True).start().awaitTermination(60)
    else:  # by processing time: runs on until it is stopped
        query = writer.start()
        until = time.monotonic() + 60
        while spark.table(name).count() < n_wanted and time.monotonic() < until and query.exception() is None:
            time.sleep(0.5)
        query.stop()
    return sorted((r["gen_id"], r["text"], r["query"], r["stopped"]) for r in spark.table(name).collect())


def test_stop_tag_stream(spark, tmp_path):
    lines = [r.asDict() for r in tokens(spark).collect()]
    files = [lines[n:n + 2] for n in range(0, len(lines), 2)]
    found = streamed(spark, tmp_path, [files[n * 3 % len(files)] for n in range(len(files))], "stops", 4, wait_ms=600_000)
    assert [f for f in found if f[0] != "d"] == [(g, *w) for g, (_, w) in sorted(STREAMS.items()) if g != "d"] and ("d", "x", "q", True) in found and len(found) == 4


def test_a_lost_token_does_not_stop_the_stream(spark, tmp_path):
    """Number 1 never comes: the batch and the streaming form go on without it, and what follows a finished generation tells nothing."""
    token = lambda g, n, text, done=False: {"gen_id": g, "seq": n, "response": text, "done": done}
    files = [[token("a", 0, "one "), token("b", 0, "look <CER"), '{"gen_id": "a", "seq": 1, "resp'], [token("a", 2, "three "), token("b", 2, "CA: it >")], [token("a", 3, "end", True), token("b", 3, " more", True)], [token("a", 9, "late <CERCA: x >")]]
    want = [("a", "one three end", None, False), ("b", "look", "it", True)]
    assert streamed(spark, tmp_path, files, "lost") == want
    rows = spark.createDataFrame([(x["gen_id"], x["seq"], x["response"], x["done"]) for f in files for x in f if not isinstance(x, str)], stop_tag.TOKENS)
    assert sorted(map(tuple, stop_tag.generations(rows).select("gen_id", "text", "query", "stopped").collect())) == want


def test_a_gap_is_given_up_after_its_time(spark, tmp_path):
    token = lambda n, text, done=False: {"gen_id": "a", "seq": n, "response": text, "done": done}
    other = [{"gen_id": f"z{i}", "seq": 0, "response": "z", "done": True} for i in range(3)]
    found = streamed(spark, tmp_path, [[token(0, "one "), token(2, "three", True)], *[[o] for o in other]], "gaps", 4, wait_ms=1, memory_ms=600_000)
    assert ("a", "one three", None, False) in found and len(found) == 4


def test_ingest_stream(spark, tmp_path):
    chunks = spark.createDataFrame([("A -- knows -- B", "f", 0), ("no triple here", "f", 1), ("C -- knows -- A", "g", 0)], "text string, source_file string, chunk_index int")
    chunks.write.parquet(str(tmp_path / "in"))
    store = GraphStore(spark, str(tmp_path / "g"))
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest_stream(stream, store, str(tmp_path / "cp"), model=providers.PatternTriples()).awaitTermination(60)
    assert sorted((r["name"], r["num_chunks"], r["num_triples"], r["status"]) for r in store.table("documents").collect()) == [("f", 2, 1, "done"), ("g", 1, 1, "done")]
    edges = store.table("edges").collect()
    assert {(r["src_norm"], r["dst_norm"], r["chunk_text"]) for r in edges} == {("a", "b", "A -- knows -- B"), ("c", "a", "C -- knows -- A")} and all(len(r["predicate_embedding"]) == 64 for r in edges)


def test_failures_stay_in_their_minibatch(spark, tmp_path):
    class Fragile:
        """Fails on a batch that holds a bad text."""

        def beams(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("can't read this")
            return providers.PatternTriples().beams(texts)

    rows = [(f"A{i} -- knows -- B{i}" if i != 20 else "bad", "f" if i < 16 else "g" if i < 32 else "h", i) for i in range(48)]
    spark.createDataFrame(rows, "text string, source_file string, chunk_index int").coalesce(1).write.parquet(str(tmp_path / "in"))
    store = GraphStore(spark, str(tmp_path / "g"))
    stream = spark.readStream.schema("text string, source_file string, chunk_index int").parquet(str(tmp_path / "in"))
    ingest_stream(stream, store, str(tmp_path / "cp"), model=Fragile()).awaitTermination(60)
    assert sorted((r["name"], r["num_chunks"], r["num_triples"], r["status"]) for r in store.table("documents").collect()) == [("f", 16, 16, "done"), ("g", 16, 0, "error"), ("h", 16, 16, "done")]


def test_a_replayed_epoch_is_written_once(spark, tmp_path):
    """The stream's checkpoint loses its last commit, as after a failure: the epoch comes again and is skipped."""
    import shutil

    spark.createDataFrame([("A -- knows -- B", "f", 0)], "text string, source_file string, chunk_index int").write.parquet(str(tmp_path / "in"))
    store = GraphStore(spark, str(tmp_path / "g"))
    for _ in range(2):
        stream = spark.readStream.schema("text string, source_file string, chunk_index int").parquet(str(tmp_path / "in"))
        ingest_stream(stream, store, str(tmp_path / "cp"), model=providers.PatternTriples()).awaitTermination(60)
        assert store.table("edges").count() == 1 and store.table("documents").first()["num_chunks"] == 1 and store.seen(str(tmp_path / "cp")) == 0
        shutil.rmtree(tmp_path / "cp" / "commits")


def test_an_ingest_of_many_minibatches_writes_little(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    written = []
    kept = store._write
    store._write = lambda name, number, df: (written.append((name, df.count())), kept(name, number, df))[1]
    for i in range(20):
        store.write_triples(triples(spark, *((f"A{j}", "p", f"B{i}.{j}", "f", i) for j in range(10))))
    assert store.table("edges").count() == 200 and store.table("entities").count() == 210 and store.stats() == {"nodes": 210, "relations": 200}
    assert sum(n for name, n in written if name == "edges") == 200 + 160  # each row once, and the first sixteen parts once more
    assert store.info()["parts"] == {"entities": 5, "edges": 5} and store.is_connected()
    assert len(list((tmp_path / "g").glob("manifest-*"))) <= 4 and len(list((tmp_path / "g").glob("edges-*"))) <= 5 + 16


def test_orchestration(spark):
    script = {
        "Search results:\n[1] (Source: s)\nfacts about cats": "cats are animals [1]", "Search results:\n[1] (Source: s)\nfacts about why": "because [1]", "Search results:\n[1] (Source: s)\nfacts about loop": "again <CERCA: loop>",
        "Draft:\ncats": "Cats are animals. [1]", "Draft:": " ", "tell cats": "I look. <CERCA: cats>", "tell loop": "first <CERCA: loop>", "tell why": "no idea",
    }
    questions = spark.createDataFrame([(1, "tell cats"), (2, "why"), (3, "tell loop")], "run_id int, question string")

    def retrieve(q):
        return q.select("run_id", F.lit(0).alias("rank"), F.concat(F.lit("facts about "), "query").alias("document"), F.lit("s").alias("source"), F.lit(0).alias("chunk_index"), F.lit(0.5).alias("distance"), F.concat(F.lit("id "), "query").alias("source_id"))

    found = orchestrate.run(questions, providers.Scripted(script, "dunno"), retrieve)
    results = {r["run_id"]: (r["intermediate_text"], r["final_response"], r["total_iterations"]) for r in found.results.collect()}
    assert results == {1: ("cats are animals [1]", "Cats are animals. [1]", 1), 2: ("because [1]", "because [1]", 1), 3: ("again", "again", 3)}
    assert sorted((r["run_id"], r["iteration"], r["query"]) for r in found.events.collect()) == [(1, 1, "cats"), (2, 1, "[FALLBACK] why"), (3, 1, "loop"), (3, 2, "loop"), (3, 3, "loop")]
    assert found.sources.count() == 3


def test_scratch_tables_go(spark):
    scratch.clear(spark)
    kept = scratch.written(spark.range(3), "t")
    assert kept.count() == 3 and kept.inputFiles()[0].startswith("file:")
    assert scratch.clear(spark) == 1 and scratch.clear(spark) == 0
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(kept.inputFiles()[0])


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(i * 37 % 101, "x") for i in range(101)], "id int, t string").repartition(7)
    assert all(r["n"] == r["id"] for r in files.numbered(rows, F.col("id"), "n").collect())
