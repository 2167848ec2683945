import random

import pytest
from pyspark.sql import functions as F

from groundline import providers
from groundline.functions import markup, scores, text
from groundline.functions.stemming import stem


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(("n", "chunks"), [(0, 0), (1, 1), (150, 1), (151, 2), (200, 2), (300, 2), (301, 3)])
def test_word_windows(spark, n, chunks):
    found = one(spark, text.word_windows(F.col("t")), " ".join(f"w{i}" for i in range(n)))
    assert len(found) == chunks
    assert all(len(c.split()) == min(200, n - 150 * i) for i, c in enumerate(found))


@pytest.mark.parametrize(("n", "chunks"), [(0, 0), (450, 1), (451, 2), (500, 2), (901, 3)])
def test_char_windows(spark, n, chunks):
    assert len(one(spark, text.char_windows(F.col("t")), "x" * n)) == chunks


def test_char_windows_drop_blank_ones_before_numbering(spark):
    assert one(spark, text.char_windows(F.col("t"), 4, 0), "abcd        ef") == ["abcd", "ef"]
    with pytest.raises(ValueError):
        text.char_windows(F.col("t"), 10, 10)


def test_windows_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", text.word_windows(F.col("text")).alias("w"), text.char_windows(F.col("text")).alias("c")).collect()
    for r in docs:
        w = r["text"].split()
        assert r["w"] == [" ".join(w[i:i + 200]) for i in range(0, len(w), 150)]
        assert r["c"] == [p for i in range(0, len(r["text"]), 450) if (p := r["text"][i:i + 500].strip())]


def test_windows_are_linear_in_a_text(spark):
    """Four times the text takes about four times as long, not sixteen."""
    import time

    def seconds(n):
        df = spark.createDataFrame([(" ".join(f"wörd{i}" for i in range(n)),)], "t string")
        began = time.perf_counter()
        df.select(F.size(text.word_windows(F.col("t"))), F.size(text.char_windows(F.col("t")))).collect()
        return time.perf_counter() - began

    seconds(20_000)
    assert seconds(320_000) < 8


def test_white_space_is_unicode(spark):
    odd = " 　 a b\x1cc\u0085"
    assert one(spark, text.words(F.col("t")), odd) == odd.split()
    assert one(spark, text.strip(F.col("t")), odd) == odd.strip()


def test_spaces_are_those_of_the_pattern(spark):
    every = "".join(chr(i) for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000)
    assert set(one(spark, F.regexp_replace("t", f"[^{text.SPACE[1:-1]}]", ""), every)) == set(text.SPACES) == {c for c in every if c.isspace()}
    assert one(spark, text.strip(F.col("t")), text.SPACES + "é x" + text.SPACES) == "é x" and one(spark, text.strip(F.col("t")), text.SPACES) == ""


def test_sentences_and_facts(spark):
    two = one(spark, text.sentences(F.col("t")), "This is the first sentence. This is the second sentence.")
    assert len(two) == 2 and "first" in two[0]
    assert one(spark, text.sentences(F.col("t")), "") == []
    facts = one(spark, text.atomic_facts(F.col("t")), "Paris is the capital of France. Yes. It has 2.1 million people. No way!")
    assert facts == ["Paris is the capital of France.", "It has 2.1 million people."]


@pytest.mark.parametrize(("value", "want"), [(None, "d"), (" NaN ", "d"), ("None", "d"), ("", "d"), (" x ", "x")])
def test_cleaned(spark, value, want):
    assert one(spark, text.cleaned(F.col("t"), "d"), value) == want


@pytest.mark.parametrize(("said", "want"), [("Chi è Tenma", True), ("Tenma lavora", False), ("It rains?", True), ("  WHO wrote it", True), ("whose book", False)])
def test_questions(spark, said, want):
    assert one(spark, text.is_question(F.col("t")), said) is want


@pytest.mark.parametrize(("raw", "want"), [
    ('ok {"subject": "?", "predicate": "born in", "object": " Ulm "} x', (None, "born in", "Ulm")), ('{"subject": {"a": 1}}', (None, None, None)), ("no json", (None, None, None)), ('{"subject": "null", "object": ""}', (None, None, None)),
])
def test_slots(spark, raw, want):
    assert tuple(one(spark, text.slots(F.col("t")), raw)) == want


def test_escape_order(spark):
    assert one(spark, text.escaped(F.col("t")), "<a href='x'>\"&amp;\"") == "&lt;a href=&#39;x&#39;&gt;&quot;&amp;amp;&quot;"


@pytest.mark.parametrize(("source", "want"), [
    ("<s><triplet> Paris <subj> France <obj> capital of</s>", [("Paris", "capital of", "France")]),
    ("<triplet> S <subj> O1 <obj> R1 <subj> O2 <obj> R2", [("S", "R1", "O1"), ("S", "R2", "O2")]),
    ("<triplet> S <subj> O1 <obj> R1 <subj> O2", [("S", "R1", "O1"), ("S", "R1", "O2")]),
    ("<triplet> A <per> B <loc> lives in<triplet> C <org> D <loc> based in", [("A", "lives in", "B"), ("C", "based in", "D")]),
    ("<triplet> A <subj> B <obj> r1 <relation> C <subj> D <obj> r2", [("A", "r1", "B"), ("C", "r2", "D")]),
    ("<triplet> A <subj> B", []), ("<triplet> A <subj> B <obj>", []), ("plain text", []), ("<subj> x <obj> y", []), ("<triplet> A <foo bar> B <obj> r", []), (None, []),
    ("tp_XX<triplet> A <subj> B <obj> __en__ r", [("A", "r", "B")]), ("<triplet> A <> B <obj> r", [("A", "r", "B")]), ("<triplet> A<>B <subj> C <obj> r", [("A<>B", "r", "C")]),
    ("<triplet> <triplet> S <subj> O1 <obj> R1 <subj>  <obj> R2 <subj> O3", [("S", "R1", "O1"), ("S", "R2", "O3")]), ("<triplet> S <subj> O <obj> R <subj> <obj>", [("S", "R", "O")]), ("", []),
])
def test_markup(spark, source, want):
    assert [tuple(t) for t in one(spark, markup.triples_of(F.col("t")), source)] == want


def test_extraction_keeps_the_first_of_a_chunk(spark):
    t = lambda *x: "<triplet> {} <subj> {} <obj> {}".format(*x)
    beams = [t("A", "B", "r"), t("a", "b", "R") + t("A", "C", "r"), t("A", "C", "r")]
    rows = markup.extracted(spark.createDataFrame([("f", 0, beams), ("f", 1, beams[:1])], "source_file string, chunk_index int, beams array<string>")).orderBy("chunk_index", "beam", "pos").collect()
    assert [(r["chunk_index"], r["subject"], r["predicate"], r["object"]) for r in rows] == [(0, "A", "r", "B"), (0, "A", "r", "C"), (1, "A", "r", "B")]


@pytest.mark.parametrize(("a", "b", "want"), [("hello world", "hello world", 1.0), ("hello", "hello world", 0.8), ("foo bar", "baz qux", 0.0), ("", "abc", 0.8), (" Hello", "hello ", 1.0)])
def test_containment(spark, a, b, want):
    assert one(spark, scores.containment(F.col("t"), F.lit(b)), a) == want


def test_lcs_against_a_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        assert scores.lcs_length(a, b) == rows[-1][-1]


@pytest.mark.parametrize(("score", "level", "alpha"), [(0.8, "high", "0.80"), (0.79, "medium", "0.79"), (0.5, "medium", "0.50"), (0.3, "low", "0.30"), (0.29, "none", "0.29"), (0.0, "none", "0.15"), (1.5, "high", "1.00")])
def test_levels(spark, score, level, alpha):
    assert one(spark, F.concat_ws(" ", scores.level(F.lit(score)), scores.alpha(F.lit(score)))) == f"{level} {alpha}"


@pytest.mark.parametrize(("word", "want"), [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"),
    ("conditional", "condit"), ("vietnamization", "vietnam"), ("operator", "oper"), ("electriciti", "electr"), ("hopefulness", "hope"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"),
    ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("population", "popul"), ("is", "is"),
])
def test_stems(word, want):
    assert stem(word) == want


def test_retries():
    waits, answers = [], iter([providers.ServerError(), providers.ServerError(), "x"])

    def call():
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    assert providers.retried(call, sleep=waits.append) == "x" and waits == [2.0, 4.0]
    with pytest.raises(ConnectionError):
        providers.retried(lambda: (_ for _ in ()).throw(ConnectionError()), sleep=waits.append)


def test_greedy_similarity(spark):
    a, b = [[1.0, 0.0], [0.0, 2.0]], [[3.0, 0.0]]
    df = spark.createDataFrame([(a, a), (a, b), (a, []), (None, b)], "c array<array<double>>, r array<array<double>>")
    found = [tuple(round(x, 4) for x in r["s"]) for r in df.select(scores.greedy_similarity(F.col("c"), F.col("r")).alias("s")).collect()]
    assert found == [(1.0, 1.0, 1.0), (0.5, 1.0, 0.6667), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
    assert df.select(scores.greedy_similarity(F.col("c"), F.col("r"), 0.5).alias("s")).first()["s"]["f1"] == pytest.approx(1.0)
