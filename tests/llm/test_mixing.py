import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from groundline.llm import mixing


def water(sizes, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    """Resharing by rounds, in exact fractions."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while True:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] > most * sizes[s] * total}
        if not over:
            return {**target, **{s: left * w[s] / total for s in open_}}
        for s in over:
            target[s] = Fraction(most * sizes[s])
            left -= target[s]
        open_ -= over


def corpus(seed, n=400):
    rng = random.Random(seed)
    sources = ["b", "a", "Z", None, "é", "c"]
    return [(rng.choice((i, i, None)), " ".join(["w"] * rng.choice((0, 1, 5, 40, 400))) if rng.random() < 0.95 else None, rng.choice(sources + ["a"] * 4)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_limits(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, 1, "q") for d in docs], "doc_id long, text string, source string, target int, shard string")
    found = mixing.mix_sources(df, shard_docs=16, block_tokens=8, region_shards=3)
    rows = found.collect()
    assert len(rows) == len(docs)
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").split()) for _, t, _ in docs)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    by = {r["source_size"]: float(want[s]) for s, z in sizes.items() for r in rows if r["source_size"] == z}
    for z, t in by.items():
        own = [r for r in rows if r["source_size"] == z]
        assert all(r["target"] == pytest.approx(t) for r in own)
        assert abs(sum(r["taken"] for r in own) - t) <= 2 * 8 * (len(own) // 16 + 2)  # a shard may miss a block by its number, and part of one by its short end
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(df, shard_docs=16, block_tokens=8, region_shards=3).collect()))


@pytest.mark.parametrize(("weights", "seats"), [([53, 24, 23], 7), ([10, 10, 10], 4), ([1, 1000], 9), ([5], 3), ([0, 7, 3], 10), ([1, 1], 0), ([100, 1, 1, 1, 1, 1], 13)])
def test_seats_by_highest_quotients(spark, weights, seats):
    quotients = sorted(((-Fraction(w, 2 * k + 1), i, k) for i, w in enumerate(weights) for k in range(seats) if w), key=lambda x: x)[:seats]
    units = spark.createDataFrame([(i, w, seats, "g") for i, w in enumerate(weights)], "u int, w long, s long, grp string")
    found = {r["u"]: r["quota"] for r in mixing.apportion(units, ["grp"], ["u"], "w", "s").collect()}
    assert found == {i: sum(q[1] == i for q in quotients) for i in range(len(weights))}


def test_no_window_of_all_shards(spark):
    """The windows over shards are by region too; those by source alone are over regions."""
    df = spark.createDataFrame(corpus(3), "doc_id long, text string, source string")
    plan = mixing.mix_sources(df, shard_docs=4, region_shards=5)._jdf.queryExecution().optimizedPlan().toString()
    ranked = [line for line in plan.split("\n") if "row_number()" in line and "shard#" in line]
    assert ranked and all(re.search(r"windowspecdefinition\(source#\w+, region#", line) for line in ranked)


def test_empty_and_wordless(spark):
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    rows = mixing.mix_sources(spark.createDataFrame([(1, " \t", "a"), (2, None, None)], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 2


def test_no_python_on_the_main_path(spark, sf):
    plan = mixing.mix_sources(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_taken_documents(spark):
    df = spark.createDataFrame([(1, "a b c", "s", 5), (1, "a b c", "s", 5), (2, "", "s", 0), (3, "x " * 90, "t", 180)], "doc_id long, text string, source string, n_chars long")
    out = mixing.take_documents(df)
    assert set(df.columns) | {"size", "source_size", "target", "taken"} == set(out.columns)
    assert out.where(F.col("taken") > 0).count() == out.count() and {r["doc_id"] for r in out.collect()} <= {1, 3}
