"""Triples from the markup that a seq2seq extractor writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.functions.text import bound, words

# Language tokens that the model may emit.
LANGUAGE_TOKENS = ("tp_XX", "__en__", "__it__", "__es__", "__de__", "__fr__", "__pt__", "__ro__", "__nl__", "__pl__")
TRIPLES = "array<struct<subject:string,predicate:string,object:string>>"
NOISE = r"(?U)<s>|<pad>|</s>|\b(?:" + "|".join(LANGUAGE_TOKENS) + r")\b"
#: Words between single blanks that open a subject, and that end a segment.
OPENING, MARKER = "(?<= )<(?:triplet|relation)>(?= )", "(?<= )<[^ ]*>(?= )"


def triples_of(markup: Column) -> Column:
    """Array of ``struct(subject, predicate, object)`` of a markup column; a null has none.

    ``<triplet>`` and ``<relation>`` open a block, and markers, words in angle brackets, cut it into segments: the subject, then objects
    and predicates in turn. Each object makes a triple with the segment after it; the last, if it was cut short, with the predicate
    before it. Triples with an empty part are left out, and so is all that stands before the first block.
    """
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(markup, F.lit("")), NOISE, " "), "(<[^>]+>)", " $1 ")
    blocks = F.split(F.concat(F.lit(" "), F.array_join(words(spaced), " "), F.lit(" ")), OPENING)

    def triple(segments: Column, i: Column) -> Column:
        before = F.when(i > 2, F.element_at(segments, i - 1)).otherwise("")
        predicate = F.when(i < F.size(segments), F.get(segments, i)).otherwise(before)
        return F.struct(F.get(segments, F.lit(0)).alias("subject"), predicate.alias("predicate"), F.get(segments, i - 1).alias("object"))

    def of_block(segments: Column) -> Column:
        objects = F.when(F.size(segments) > 1, F.sequence(F.lit(2), F.size(segments), F.lit(2))).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(objects, lambda i: triple(segments, i)), lambda t: (t["subject"] != "") & (t["predicate"] != "") & (t["object"] != ""))

    found = F.transform(blocks, lambda b, n: F.when(n == 0, F.array().cast(TRIPLES)).otherwise(bound(F.transform(F.split(b, MARKER), lambda s: F.trim(s)), of_block)))
    return F.flatten(found)


def extracted(chunks: DataFrame, beams: str = "beams") -> DataFrame:
    """A row per triple of chunks with an array of markup ``beams``: of equal triples of a chunk, case aside, the first stays.

    ``source_file, chunk_index`` name a chunk; ``beam`` and ``pos`` tell where the triple was.
    """
    keys = [c for c in chunks.columns if c != beams]
    each = chunks.select(*keys, F.posexplode(beams).alias("beam", "markup")).select(*keys, "beam", F.posexplode(triples_of(F.col("markup"))).alias("pos", "t")).select(*keys, "beam", "pos", "t.*")
    first = Window.partitionBy("source_file", "chunk_index", F.lower("subject"), F.lower("predicate"), F.lower("object")).orderBy("beam", "pos")
    return each.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
