import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groundline.llm import decontamination, quality, resampling

ODD = ["", None, " \n\t", "a", "a a a", "x " * 60, "one two three\n" * 20, "über\x0bstraße " * 30, "\n\n\n", "a b c " * 40, " ".join(f"w{i}" for i in range(80)), "# $ % " * 30, "l\nl\n \nl\n" + " ".join(map(str, range(60)))]


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup, dup_chars = text.split("\n"), set(), 0, 0
    for x in lines:
        own = re.findall(r"[^\x20\x09-\x0D]+", x)
        if own and x in seen:
            dup += 1
            dup_chars += sum(map(len, own))
        seen.add(x)

    def places(n):
        grams = [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]
        many = Counter(grams)
        return {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(n)}

    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(places(3)), dup_chars, *(sum(len(w[i]) for i in places(n)) for n in quality.COVERAGE_LIMITS))


def test_repetition(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(9000 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(i, t, True) for i, t in docs], "doc_id long, text string, kept boolean")
    found = {r["doc_id"]: r for r in quality.repetition(df).collect()}
    for i, t in docs:
        want = brute_quality(t)
        assert tuple(found[i][c] for c, _ in quality.COLUMNS) == want
        assert found[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (found[i]["kept"] and found[i]["base_failed"])
    assert found[9010]["kept"] and not found[9011]["kept"]
    assert quality.repetition(df.limit(0)).count() == 0


ITEM = "A train leaves Boston at 9 am and covers 120 km in 2 hours; what is the speed of the train that left Boston?"
BENCHMARK = [(1, ITEM), (2, None), (3, ""), (4, "1 2 3 4 5 6 7"), (5, "Two words"), (1, ITEM), (6, "The quick brown fox jumps over the lazy dog near the old river bank today.")]


CASES = [
    (f"Some text before. {ITEM} And after.", [1], False), (ITEM.upper().lower(), [1], False), ("x " + ITEM.replace("Boston", "Chicago").replace("120", "300").replace(" 2 ", " 5 "), [1], True),
    (ITEM[:40], [], False), ("", [], False), (None, [], False), ("here are two words", [5], False), ("9 8 7 6 5 4 3 2", [], False), ("see 1 2 3 4 5 6 7 there", [4], False),
    ("The quick brown fox jumps over the lazy dog near some other place far away now.", [6], False), ("y " * 4000 + ITEM + " z" * 4000, [1], False), (ITEM.upper(), [1], False), (ITEM.title(), [1], False),
    (ITEM.replace("Boston", "Chicago", 1), [1], False), (ITEM.replace("120", "7").replace(" 2 ", " 7 ").replace(" 9 ", " 7 "), [1], True), ("Now: paris LONDON rome, Berlin Madrid Vienna Prague. Yes", [8], False),
    (" and ".join(ITEM.replace("Boston", c).replace("120", n) for c, n in (("Chicago", "300"), ("Dallas", "77"))), [1], True),
]


def test_templates(spark):
    """Verbatim copies, in other capitals, re-parameterised ones, twice with other values, and none; all in one table."""
    benchmark = spark.createDataFrame([(*b, "e") for b in [*BENCHMARK, (8, "Paris London Rome Berlin Madrid Vienna Prague"), (None, "unnamed item with some words")]], "item_id long, text string, extra string")
    docs = spark.createDataFrame([(i, t, "m") for i, (t, _, _) in enumerate(CASES)] + [(None, ITEM, "m"), (0, CASES[0][0], "m")], "doc_id long, text string, matches string")
    rows = decontamination.decontaminate(docs, benchmark).collect()
    assert len(rows) == len(CASES) + 2 and [r["item_ids"] for r in rows if r["doc_id"] is None] == [[1]] and sum(r["doc_id"] == 0 for r in rows) == 2
    for r in rows:
        if r["doc_id"] is not None:
            _, items, changed = CASES[r["doc_id"]]
            assert (r["item_ids"], r["kept"]) == (items, not items) and (not changed or r["reparameterised"]), CASES[r["doc_id"]]
            assert not r["contaminated"] or 0.5 <= r["containment"] <= 1
    clashing = docs.withColumns({"row": F.lit(1), "match_id": F.lit(2), "_row": F.lit(3), "text2": F.col("text")})
    kept = decontamination.clean_documents(clashing, benchmark)
    assert kept.columns == clashing.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in enumerate(CASES) if not c[1])


def canonical(text):
    """Template tokens of a text from the rules, one word at a time: (token, kind, value)."""
    out, after, number = [], True, False
    for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        low, kind, capital, end = decontamination._token(word)
        if kind == decontamination.UNIT and not number:
            kind = decontamination.WORD_KIND
        if kind == decontamination.WORD_KIND and capital and not after:
            kind = decontamination.NAME
        out.append((low if kind == decontamination.WORD_KIND else ("slot", kind), kind, low))
        after, number = end, kind == decontamination.NUM
    return out


def brute_leak(item, doc, width=5):
    """Largest share of the item's windows in the document, by comparing every window with every other."""
    a, b = canonical(item), canonical(doc)
    w = min(width, len(a))
    if not w:
        return 0.0
    places = range(len(a) - w + 1)
    plain = sum(any(all(a[p + j][2] == b[q + j][2] for j in range(w)) for q in range(len(b) - w + 1)) for p in places) / len(places)
    use = [p for p in places if sum(x[1] == 0 for x in a[p:p + w]) >= min(decontamination.LITERALS, w)]
    met = [(p, q) for p in use for q in range(len(b) - w + 1) if all(a[p + j][0] == b[q + j][0] for j in range(w))]
    if len({p for p, _ in met}) < 0.5 * len(use) or not use:
        return plain
    votes = {}
    for p, q in met:
        for j in range(w):
            if a[p + j][1]:
                votes.setdefault(a[p + j][1:], {}).setdefault(b[q + j][2], set()).add(p + j)
    value = lambda v: int(pd.util.hash_array(np.array([v], dtype=object), categorize=False).view(np.int64)[0])
    most = {k: max(v, key=lambda x: (len(v[x]), x == k[1], value(x))) for k, v in votes.items()}
    held = {p for p, q in met if all(not a[p + j][1] or b[q + j][2] in (a[p + j][2], most[a[p + j][1:]]) for j in range(w))}
    return max(plain, len(held) / len(use))


def test_templates_against_brute_force(spark):
    rng = random.Random(4)
    names, words = ["Boston", "Chicago", "Anna", "Peter"], ["train", "leaves", "and", "the", "speed", "covers", "of", "in", "how", "far"]
    make = lambda n: " ".join(rng.choice([rng.choice(words), rng.choice(words), rng.choice(names), str(rng.randint(1, 4)), f"{rng.randint(1, 3)} km"]) for _ in range(n))
    items = [(i, make(rng.choice([2, 4, 8, 14, 20]))) for i in range(12)]
    docs = []
    for i in range(60):
        t = items[rng.randrange(12)][1]
        for old in rng.sample([*names, "1", "2", "3"], 2):
            t = t.replace(old, rng.choice([*names, "3", "9"]), rng.choice([1, 1, 9]))
        docs.append((i, " ".join([make(rng.randint(0, 10)), rng.choice([t, t.upper(), t + " " + t.replace("1", "8"), make(15)]), make(rng.randint(0, 6))])))
    found = {r["doc_id"]: r for r in decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, text in docs:
        shares = {k: brute_leak(item, text) for k, item in items}
        assert found[i]["item_ids"] == [k for k, v in shares.items() if v >= 0.5], text
        assert found[i]["containment"] == pytest.approx(max([v for v in shares.values() if v >= 0.5], default=0.0))


def test_leaks_against_brute_force(spark, sf):
    docs, benchmark = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    found = {r["doc_id"]: r for r in decontamination.decontaminate(docs, benchmark).collect()}
    items = {r["item_id"]: r["text"] for r in benchmark.collect()}
    for r in docs.collect():
        held = {i for i, t in items.items() if t in r["text"]}
        assert held <= set(found[r["doc_id"]]["item_ids"]) and found[r["doc_id"]]["contaminated"] == bool(held)
    assert decontamination.decontaminate(docs.limit(0), benchmark).count() == 0
    clean = decontamination.decontaminate(docs, benchmark.limit(0))
    assert clean.where("contaminated").count() == 0 and clean.count() == docs.count()


def test_resampling(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = resampling.classify(docs, labels).join(labels, "doc_id").collect()
    rate = lambda q, t: np.mean([r["kept"] for r in rows if r["quality"] == q and (t is None or r["toxic"] == t)])
    assert rate(1, 0) > 0.98 and rate(0, None) < 0.1
    again = resampling.classify(docs.repartition(5), labels)
    assert {(r["doc_id"], r["kept"]) for r in again.collect()} == {(r["doc_id"], r["kept"]) for r in resampling.classify(docs, labels).collect()}


def test_resampling_rejects_toxic_prose(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = labels.where("doc_id % 4 = 0 and quality = 1")
    rows = resampling.classify(docs, labels.where("doc_id % 4 <> 0")).join(held, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    gone = lambda toxic, lang=None: np.mean([not r["kept"] for r in rows if r["toxic"] == toxic and lang in (None, r["lang"])])
    assert gone(1, "en") > 0.95 and gone(1) > 0.75 and gone(0) < 0.01


def test_resampling_edges(spark):
    docs = spark.createDataFrame([(1, "good words here", 0.5), (2, None, 0.5), (None, "", 0.5), (3, "x " * 5000, 0.5), (3, "x " * 5000, 0.5)], "doc_id long, text string, importance double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["kept"] for r in resampling.classify(docs, none).collect()] == [True] * 5
    odd = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (3, None, None), (77, 1, 0)], "doc_id long, quality int, toxic int")
    assert resampling.classify(docs, odd).count() == 5 and resampling.select(docs, odd).columns == docs.columns
    assert resampling.classify(docs.limit(0), odd).count() == 0


def test_the_k_th_key(spark):
    rng = random.Random(2)
    values = [round(rng.uniform(-3, 1), 3) for _ in range(500)] + [0.25] * 50 + [-1e12] * 3
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (0, 1, 7, 100, 300, 550, 551, 553, 554):
        least = resampling.kth_largest(df, "key", k)
        want = float("inf") if k == 0 else -float("inf") if k >= len(values) else sorted(values, reverse=True)[k - 1]
        assert least == want


def model_rows(texts):
    """Counts of a text's n-grams in a dictionary: (family, n-gram) to number."""
    out = []
    for t in texts:
        out.append(Counter(g for kind in resampling.ngrams(resampling.tokenised([t or ""])) for g in kind.tolist()))
    return out


def test_importance_against_brute_force(spark):
    """Whole texts' log ratios, keys and the k largest, recomputed with dictionaries from the counts of single texts."""
    texts = ["the cat sat on the mat", "a dog ran off", None, "", "$$ BUY %% NOW $$ BUY NOW", "the dog sat on a mat near the cat " * 30, "w " * 3000, "the cat sat on the mat", "$$ !!"] * 4
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, importance int")
    labels = spark.createDataFrame([(i, int("$" not in (texts[i] or "")), 0) for i in range(20)], "doc_id long, quality int, toxic int")
    grams = model_rows(texts)
    seed, ids = 5, spark.createDataFrame([(i,) for i in range(20)], "i long")
    fits = {r["i"] for r in ids.selectExpr("i", f"pmod(xxhash64(i, {seed}), 2) = 0 as f").where("f").collect()}
    raw, target = Counter(), Counter()
    for i, g in enumerate(grams):
        raw.update(g)
        if i in fits and "$" not in (texts[i] or ""):
            target.update(g)
    ends = np.cumsum([0, 1 << resampling.BITS, 1 << resampling.BITS, 1 << resampling.SHAPE_BITS, 1 << resampling.SHAPE_BITS])
    family = lambda g: int(np.searchsorted(ends, g, side="right")) - 1
    share = {f: sum(n for g, n in target.items() if family(g) == f) / sum(n for g, n in raw.items() if family(g) == f) for f in range(4)}
    ratio = {g: math.log((target[g] + resampling.PRIOR) / (raw[g] * share[family(g)] + resampling.PRIOR)) for g in raw}
    want = [sum(n * ratio[g] for g, n in own.items()) / 4 if own else resampling.EMPTY for own in grams]
    rows = {r["doc_id"]: r for r in resampling.classify(docs, labels, k=11).collect()}
    for i, v in enumerate(want):
        assert rows[i]["importance"] == pytest.approx(v, rel=1e-5, abs=1e-4)
    keys = sorted((r["sampled_key"] for r in rows.values()), reverse=True)
    assert {i for i, r in rows.items() if r["kept"]} == {i for i, r in rows.items() if r["sampled_key"] >= keys[10]}
    noise = [r["sampled_key"] - r["importance"] for i, r in rows.items() if texts[i]]
    assert max(noise) - min(noise) > 1  # the draw isn't a threshold


def test_inclusion_follows_the_weights(spark):
    """Documents of two importances, one half drawn: of each sort as many stay as sampling without replacement by weight gives."""
    texts = ["good plain words here today"] * 1500 + ["other stuff lives there now"] * 1500
    docs = spark.createDataFrame([(i, f"{t}") for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 1500, 5)] + [(i, 1, 0) for i in range(1500, 3000, 15)], "doc_id long, quality int, toxic int")
    rows = resampling.classify(docs, labels, k=1500, temperature=2.0).collect()
    value = [next(r["importance"] for r in rows if r["doc_id"] == i) for i in (0, 2000)]
    kept = [np.mean([r["kept"] for r in rows if (r["doc_id"] < 1500) == first]) for first in (True, False)]
    # exponential clocks at rates exp(importance / temperature): the time by which half of all have rung gives both shares
    low, high, rates = 0.0, 1e6, [math.exp(v / 2.0) for v in value]
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(1 - math.exp(-r * mid) for r in rates) < 1 else (low, mid)
    want = [1 - math.exp(-r * low) for r in rates]
    assert kept == pytest.approx(want, abs=0.04) and 0.02 < want[1] < 0.48


def test_clashing_columns_of_select(spark):
    docs = spark.createDataFrame([(1, "good words", 1, "a", 2, "x y"), (2, None, 1, "b", 2, None)], "doc_id long, text string, _role int, draw string, importance int, `Key` string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    kept = resampling.select(docs, labels, k=2)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
