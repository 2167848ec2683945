import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from groundline.llm import decontamination, jaccard, mixing, pii, resampling
from groundline.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's rows on the small data, as the driver writes and reads them."""
    sf, found = "/root/testdata/sf0.01", {}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found["documents"] = docs.toPandas().set_index("doc_id")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf), f"test-{name}")
        found[name] = docs.toPandas().set_index("doc_id")
    return found


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages)[1:]
    for name in list(stages)[:-1]:
        assert list(stages[name].columns) == list(stages["documents"].columns)
    names = list(stages)
    for a, b in zip(names, names[1:]):
        assert set(stages[b].index) <= set(stages[a].index) and stages[b].index.is_unique


def test_near_copies(stages):
    before, after = stages["quality_classifier"], stages["near_copies"]
    sets = {}
    for i, t in before["text"].items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    pairs = {(a, b) for h in holders.values() if len(h) > 1 for n, a in enumerate(h) for b in h[n + 1:]}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert set(after.index) == {i for i in sets if root(i) == i}


def test_later_stages(stages):
    bench = pd.read_parquet("/root/testdata/sf0.01/benchmark.parquet")
    assert not any(t in d for d in stages["benchmark_leaks"]["text"] for t in bench["text"])
    lost = stages["near_copies"].loc[stages["near_copies"].index.difference(stages["benchmark_leaks"].index)]
    assert all(any(t in d for t in bench["text"]) for d in lost["text"])
    clean = stages["personal_data"]
    assert not any(pii.base_spans(t) for t in clean["text"]) and (clean["n_chars"] == clean["text"].str.len()).all()
    mixed = stages["mix"]
    assert (mixed["taken"] > 0).all() and (mixed["taken"] <= 2 * mixed["size"]).all()


CLASHING = ["_text", "_row", "row", "stays", "size", "target", "taken", "like", "_spans", "spans", "n_email", "redacted", "matches", "match_row", "role", "key", "importance", "_toxicity", "block", "a b", "a.b", "`q"]


def test_rows_that_clash(spark):
    """Each stage's function keeps rows with nulls, repeated rows and columns of all the names it uses itself."""
    rows = [(1, "same words in this text " * 3, "en", "s", 1), (1, "same words in this text " * 3, "en", "s", 1), (None, "other", "en", None, 1), (2, None, None, "s", None), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame([(*r, *CLASHING) for r in rows], pd_schema := "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in CLASHING))
    bench = spark.createDataFrame([(1, "same words in this text")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    stages = {
        "select": (lambda d: resampling.select(d, labels, k=5), 5), "near": (jaccard.drop_near_copies, 4), "leaks": (lambda d: decontamination.clean_documents(d, bench), 3), "pii": (pii.redact_documents, 5), "mix": (mixing.take_documents, None),
    }
    for name, (stage, n) in stages.items():
        found = stage(docs)
        assert found.columns[:len(docs.columns)] == docs.columns and len(set(map(str.lower, found.columns))) == len(found.columns), name
        kept = corpus_pipeline.written(found, "clash").collect()
        assert n is None or len(kept) == n, name
        assert all(list(r)[5:5 + len(CLASHING)] == CLASHING for r in kept), name
        assert stage(spark.createDataFrame([], pd_schema)).count() == 0, name


def test_empty_tables(spark, tmp_path):
    """The whole pipeline over tables without rows."""
    sf = "/root/testdata/sf0.001"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, found = con.execute(ORACLE_SQL[name]).df(), QUERIES[name](spark, sf).toPandas()
    assert sorted(want.columns) == sorted(found.columns)
    plain = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    rows = lambda df: sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)
    assert rows(want) == rows(found)
