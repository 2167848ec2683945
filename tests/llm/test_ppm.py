import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from groundline.llm import ppm

DOCS = [
    (0, "the cat sat on the mat the cat"), (1, "A cat! The Mat.\n\nthe the the"), (2, ""), (3, None), (4, "über straße naïve cat"), (5, "the cat sat on the mat the cat"),
    (6, "x" * 300), (7, "\t \n"), (8, "unseen wörds and bytes \x7f\x01"), (11, "cat\x0bmat\x0cthe\rcat"), (None, "null id"),
]


def brute(docs):
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in docs}
    counts, words = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)], Counter()
    for i, t in docs:
        b = ppm.lowered(t)
        tokens = [*re.findall(rb"[^\x20\x09-\x0D]+", b), None]
        if held[i]:
            continue
        words.update(tokens)
        s = b"\0" * ppm.ORDER + b + b"\0"
        for p in range(ppm.ORDER, len(s)):
            for k in range(ppm.ORDER + 1):
                counts[k][s[p - k:p]][s[p]] += 1
    n, v = sum(words.values()), len(words)

    def code(context, symbol):
        out, ruled = 0.0, set()
        for k in range(ppm.ORDER, -1, -1):
            seen = counts[k].get(context[len(context) - k:], {})
            left = {x: c for x, c in seen.items() if x not in ruled}
            if left:
                total = sum(left.values()) + len(left)
                if symbol in left:
                    return out + math.log10(left[symbol] / total)
                out += math.log10(len(left) / total)
            ruled |= set(seen)
        return out - math.log10(256 - len(ruled))

    for i, t in docs:
        b = ppm.lowered(t)
        tokens = [*re.findall(rb"[^\x20\x09-\x0D]+", b), None]
        s = b"\0" * ppm.ORDER + b + b"\0"
        score = sum(code(s[p - ppm.ORDER:p], s[p]) for p in range(ppm.ORDER, len(s)))
        yield i, held[i], len(tokens), sum(words[w] > 0 for w in tokens), n, sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens), score


@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
def test_against_brute_force(spark, block_bytes):
    docs = [*DOCS, *((100 + i, f"row {i} of the cat " * (i % 5)) for i in range(40))]
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in docs], "doc_id long, text string, score string, block double")
    found = {r["doc_id"]: r for r in ppm.score_texts(df, block_bytes=block_bytes, bucket_bytes=300).collect()}
    assert len(found) == len(docs)
    for row in brute(docs):
        r = found[row[0]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == row[1:5]
        assert r["base_score"] == pytest.approx(row[5], rel=1e-9)
        assert r["score"] == pytest.approx(row[6], rel=1e-5)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.choice(list(b"abcd "), 200).tolist()) for _ in range(5)]
    k, c = ppm.gram_counts(texts, 1)
    k3, c3 = np.unique(np.concatenate([ppm.grams([p for _, p in ppm.padded(texts)])[0] & 0xFFFFFF]), return_counts=True)
    for context in (b"abcda", b"zzabc", b"zzzzz"):
        head = int.from_bytes(context, "big") << 8
        ask = np.arange(head, head + 256)
        keys, counts = ppm.summed([k, ask], [c, np.zeros(256, np.int64)])
        logs = ppm.log_probabilities(keys, counts, ppm.Short(k3, c3))
        assert (10 ** logs[np.searchsorted(keys, ask)]).sum() == pytest.approx(1)


def test_long_texts_in_pieces():
    rng = np.random.default_rng(5)
    texts = [b"", b"short one", b"x" * 700, bytes(rng.choice(list(b"abc \n\t"), 3000).tolist()), b" ", bytes(rng.choice(list(b"abcdefgh "), 1000).tolist())]
    for size in (1, 7, 100, 1000):
        parts = [(i, g) for of, some in ppm.chunks(texts, size) for g, begin in [ppm.grams(some)] for i, g in zip(of, np.split(g, begin[1:]), strict=True)]
        for i, t in enumerate(texts):
            assert np.concatenate([g for j, g in parts if j == i]).tolist() == ppm.grams([b"\0" * ppm.ORDER + t + b"\0"])[0].tolist()
            assert b"".join(ppm.cut(t, size)) == t and [w for p in ppm.cut(t, size) for w in p.split()] == t.split()
        assert sorted(w for found in ppm.word_lists(texts, size) for w in found) == sorted(w for t in texts for w in t.split())


def test_empty_table(spark):
    assert ppm.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_each_count(spark):
    df = spark.createDataFrame([(0, "a b c")] * 3, "doc_id long, text string")
    rows = ppm.score_texts(df).collect()
    assert len(rows) == 3 and {r["train_tokens"] for r in rows} == {12}
