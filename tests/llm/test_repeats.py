import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from groundline.llm import repeats


def brute(docs):
    first, out = {}, []
    texts = [(i, (t or "").encode()) for i, t in docs]
    key = lambda i: (i is None, i or 0)
    for i, t in texts:
        for p in range(len(t) - 49):
            w = t[p:p + 50]
            first[w] = min(first.get(w, key(i)), key(i))
    for i, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - 49):
            if first[t[p:p + 50]] < key(i):
                gone[p:p + 50] = [True] * 50
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=80):
    rng = random.Random(seed)
    make = lambda k, letters="abcdefghij éü\n": "".join(rng.choice(letters) for _ in range(k))
    passages = [make(rng.choice((49, 50, 51, 60, 90, 200))) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [rng.choice((make(rng.randint(0, 120)), rng.choice(passages), "ab" * rng.randint(0, 60), "z" * rng.randint(0, 90))) for _ in range(rng.randint(0, 4))]
        docs.append((rng.choice((i, i, i, i + 1)), "".join(parts)))
        if docs and rng.random() < 0.2:
            t = rng.choice(docs)[1]
            docs.append((1000 + i, t[rng.randint(0, 30):]))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = [*corpus(seed), (None, "null id " * 20), (7, None), (8, ""), (1, "null id " * 30 + "tail")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, block int, bucket string")
    found = repeats.remove_repeats(df, block_bytes=2500, file_bucket_bytes=5000, stretch_bucket_bytes=4000)
    rows = found.collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows), key=str) == brute(docs)
    assert all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] == r["n_bytes"] - sum(r["span_ends"]) + sum(r["span_starts"]) for r in rows)


def test_texts_hashed_in_parts(spark, monkeypatch):
    docs = [*corpus(3), (2000, "".join(t for _, t in corpus(4))), (2001, "-".join(t for _, t in corpus(4)))]
    whole = repeats.stretches([t.encode() for _, t in docs])
    parts = repeats.stretches([t.encode() for _, t in docs], 777)
    at = lambda s: sorted((b + k, t, f) for b, n, t, f in zip(s.begin.tolist(), s.windows.tolist(), s.text.tolist(), s.file.tolist()) for k in range(n))
    assert at(whole) == at(parts) and len(parts.begin) > len(whole.begin)
    monkeypatch.setattr(repeats.stretches, "__defaults__", (777,))
    table = {"doc_id": [i for i, _ in docs], "text": [t for _, t in docs], "block": [0] * len(docs)}
    docs_of = pa.table(table, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("block", pa.int32())]))
    told = repeats.answer_files(repeats.ask_files(docs_of, 1))
    cut = repeats.cut_out(docs_of, repeats.answer_stretches(repeats.send_stretches(docs_of, told, 1, 1)), False).to_pydict()
    found = sorted(zip(cut["doc_id"], cut["n_bytes"], cut["n_removed"], cut["n_spans"], cut["kept_sha256"]), key=str)
    assert found == brute(docs)


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_maximal_repeats_of_one_text():
    rng = random.Random(5)
    for _ in range(30):
        text = bytes(rng.choice(b"ab") for _ in range(60)) + b"\0"
        data, n = np.frombuffer(text, np.uint8), len(text)
        starts = np.arange(n)
        order, prefix = repeats.suffix_array(data, starts, np.full(n, n))
        assert [text[i:] for i in order] == sorted(text[i:] for i in range(n))
        before = np.where(starts > 0, data[starts - 1].astype(int), -1)
        found = sorted((length, tuple(sorted(order[a:b].tolist()))) for length, a, b in repeats.maximal_repeats(order, prefix, before, 3))
        want = set()
        for length in range(3, n):
            for w in {text[i:i + length] for i in range(n - length + 1)}:
                at = [i for i in range(n - length + 1) if text[i:i + length] == w]
                lefts, rights = {text[i - 1] if i else ("start", i) for i in at}, {text[i + length] if i + length < n else ("end", i) for i in at}
                if len(at) > 1 and len(lefts) > 1 and len(rights) > 1:
                    want.add((length, tuple(at)))
        assert found == sorted(want)
