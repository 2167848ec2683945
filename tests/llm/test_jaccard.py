import random
import re

import pytest

from groundline.llm import jaccard
from groundline.operators.components import components


def brute(docs, width=4, num=85, den=100):
    sets = []
    for _, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent, links = list(range(len(docs))), [0] * len(docs)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)], links[i]) for i, (d, _) in enumerate(docs))


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.7:
            words = rng.choice(docs)[1].split(" ")
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                words = words[:-rng.randint(1, 5)] or words
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice((1, 2, 3, 4, 5, 30, 60, 90)))]
        docs.append((i, " ".join(words)))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "group", "by_token"), [(1, 512, None), (2, 8, True), (3, 3, False), (4, 2, True), (5, 4, None)])
def test_against_brute_force(spark, seed, group, by_token):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, 0, b"x") for i, t in docs], "doc_id long, text string, label int, node binary")
    found = jaccard.jaccard_join(df, block_bytes=3000, bucket_bytes=2000, group=group, by_token=by_token).collect()
    assert sorted(map(tuple, found)) == brute(docs)


def test_edges(spark):
    docs = [(5, "A b C"), (4, "a B c"), (3, None), (2, ""), (1, " \t\n"), (9, "a b c d"), (8, "one"), (7, "one"), (7, "one"), (6, "x " * 5000), (0, "x x x x")]
    found = jaccard.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == brute(docs)
    assert jaccard.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_search_counts_every_partner():
    rng = random.Random(4)
    import numpy as np

    sets = [np.array(sorted(rng.sample(range(40), rng.randint(20, 36))), np.uint64) for _ in range(200)]
    lists = jaccard.Lists(sets, np.array([len(s) for s in sets]))
    for q in sets:
        want = [i for i, s in enumerate(sets) if 100 * len(set(q) & set(s)) >= 70 * len(set(q) | set(s))]
        assert lists.search(q, len(q), 70, 100).tolist() == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(found) == 61 + 40 and len({found[i] for i in range(61)}) == 1 and len({found[i] for i in range(100, 140)}) == 1 and found[0] != found[100]


@pytest.mark.parametrize("texts", [["one two"], ["one two three"], ["one", "two"]])
@pytest.mark.parametrize("width", [4, 5])
def test_blocks_of_fewer_words_than_a_shingle(texts, width):
    hashes, sizes = jaccard.shingle_sets(texts, width)
    assert sizes.tolist() == [1] * len(texts) and len(set(hashes.tolist())) == len(texts)


def test_heap_merge_of_sorted_lists():
    rng = random.Random(6)
    for _ in range(300):
        lists = [sorted(rng.sample(range(rng.choice((20, 200))), rng.randint(0, 20))) for _ in range(rng.randint(0, 12))]
        least = rng.randint(1, 13)
        held = {v: sum(v in x for x in lists) for x in lists for v in x}
        want = sorted(v for v, n in held.items() if n >= least)
        assert jaccard.merge_skip(lists, least) == (want, [held[v] for v in want])
