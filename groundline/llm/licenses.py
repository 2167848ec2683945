"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

A text is read whole: the text itself, its paragraphs, lines and sentences are pieces, and a piece is compared with the templates as
a sparse vector of words and word pairs. The inverted lists say which pieces can reach the least cosine: a term's largest
weight in any template bounds what it adds, so sums over a piece's terms bound its cosine, and only pieces whose bound
reaches it are scored. A licence file, by its name or because it is nothing but a notice, also speaks for its directory: files
without a notice of their own take the licence of the nearest directory above them that has one, found by joins of directory
paths. A document without a path inherits nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm.common import parts_of, written
from groundline.llm.license_texts import EXTENDS, templates

TEMPLATES: tuple[tuple[str, str], ...] = tuple(templates())
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Words, ends of sentences, and ends of lines and paragraphs; signs of comments before a line's words are no words.
TOKEN = re.compile(WORD + r"|[.!?](?=[\"')\]]*\s)|\n(?:[ \t]*[#/*;%-]*[ \t]*\n)+|\n")
WORDS = re.compile(WORD)
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"
#: Words that a text without a licence file's name may have beside its notice and still be a licence file.
SPARE_WORDS = 1
#: A piece of fewer words says nothing.
LEAST_WORDS = 3
#: Pieces of a hot directory in the join that looks upwards.
SALT = 32


def terms(words: list[str]) -> Counter:
    """Words and pairs of neighbours, counted."""
    return Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


@dataclass
class Index:
    """The templates' unit vectors as inverted lists, terms' inverse frequencies, and each term's bound; unknown terms weigh as the rarest."""

    lists: dict[str, list[tuple[int, float]]]
    idf: dict[str, float]
    rare: float
    words: dict[str, int]
    word_idf: np.ndarray
    word_bound: np.ndarray
    pairs: np.ndarray  #: sorted codes of known pairs of known words
    pair_idf: np.ndarray
    pair_bound: np.ndarray


@cache
def index() -> Index:
    counts = [terms(WORDS.findall(t.lower())) for _, t in TEMPLATES]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items()}
    lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
    for n, c in enumerate(counts):
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in c.items()))
        for t, k in c.items():
            lists[t].append((n, k * idf[t] / norm))
    most = {t: max(v for _, v in found) for t, found in lists.items()}
    words = {t: i for i, t in enumerate(sorted(t for t in idf if " " not in t))}
    code = lambda t: (lambda a, b: words[a] * len(words) + words[b])(*t.split(" "))
    pairs = sorted((t for t in idf if " " in t), key=code)
    rare = max(idf.values())
    over = lambda some: np.array([idf[t] * most[t] for t in some])
    return Index(
        dict(lists), idf, rare, words, np.array([*(idf[t] for t in words), rare]), np.array([*over(words), 0.0]),
        np.array([code(t) for t in pairs]), np.array([*(idf[t] for t in pairs), rare]), np.array([*over(pairs), 0.0]),
    )


def nearest(words: list[str]) -> tuple[float, str]:
    """Best cosine of a piece's words to a template, and that template's licence. Ties go to the first template."""
    x = index()
    found, norm = Counter(), 0.0
    for t, k in terms(words).items():
        w = k * x.idf.get(t, x.rare)
        norm += w * w
        for n, v in x.lists.get(t, ()):
            found[n] += w * v
    if not found:
        return 0.0, ""
    n = min(found, key=lambda i: (-round(found[i] / math.sqrt(norm), 12), i))
    return found[n] / math.sqrt(norm), TEMPLATES[n][0]


def pieces_of(tokens: list[str]) -> tuple[list[str], np.ndarray]:
    """Words, and the pieces as ranges of them, each once: the text, paragraphs, sentences within them, lines, and sentences within lines."""
    rank = {".": 1, "!": 1, "?": 1, "\n": 2}  # of an end: sentence, line, paragraph
    words, ends = [], ([0], [0], [0])
    for t in tokens:
        kind = rank.get(t, 3 if t[0] == "\n" else 0)
        if kind:
            ends[kind - 1].append(len(words))
        else:
            words.append(t)
    sentence, line, paragraph = (np.array(e) for e in ends)
    n, out = len(words), []
    for some in ((), (paragraph,), (sentence, paragraph), (line, paragraph), (sentence, line, paragraph)):
        edges = np.unique(np.concatenate([*some, [0, n]]))
        out.append(np.stack([edges[:-1], edges[1:]], axis=1))
    ranges = np.unique(np.concatenate(out), axis=0)
    return words, ranges[ranges[:, 1] - ranges[:, 0] >= LEAST_WORDS]


def reachable(words: list[str], ranges: np.ndarray, least: float) -> np.ndarray:
    """Pieces whose cosine may be ``least`` or more: a bound from each term's largest weight, with repeated terms counted low in the norm."""
    x = index()
    n_words = len(x.words)
    ids = np.fromiter((x.words.get(w, n_words) for w in words), np.int64, len(words))
    codes = np.where((ids[:-1] < n_words) & (ids[1:] < n_words), ids[:-1] * n_words + ids[1:], -1)
    at = np.minimum(np.searchsorted(x.pairs, codes), len(x.pairs) - 1)
    pair = np.where(x.pairs[at] == codes, at, len(x.pairs))
    a, b = ranges[:, 0], ranges[:, 1]

    def summed(word: np.ndarray, two: np.ndarray) -> np.ndarray:
        one, more = np.r_[0.0, np.cumsum(word)], np.r_[0.0, np.cumsum(two), 0.0]
        return one[b] - one[a] + more[np.maximum(b - 1, a)] - more[a]

    bound = summed(x.word_bound[ids], x.pair_bound[pair]) / np.sqrt(np.maximum(summed(x.word_idf[ids] ** 2, x.pair_idf[pair] ** 2), 1e-12))
    return ranges[bound >= least - 1e-9]


def notice(text: str | None, least: float) -> tuple[str | None, float, int]:
    """Licence, cosine and words of the best piece of a text, on ties the longest, then the first; None, 0 and 0 without one. All matched pieces
    decide between a licence and one that extends it."""
    words, ranges = pieces_of(TOKEN.findall((text or "").lower()))
    matched: set[str] = set()
    best: tuple[float, int, int, str] = (0.0, 0, 0, "")
    known: dict[tuple[str, ...], tuple[float, str]] = {}
    for a, b in reachable(words, ranges, least).tolist() if len(ranges) else ():
        piece = tuple(words[a:b])
        if piece not in known:
            known[piece] = nearest(list(piece))
        score, name = known[piece]
        if score >= least:
            matched.add(name)
            best = max(best, (round(score, 6), b - a, -a, name))
    longer = EXTENDS.get(best[3])
    return (longer if longer in matched else best[3], best[0], best[1]) if best[3] else (None, 0.0, 0)


def scan(docs: DataFrame, *, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", least: float = 0.7) -> DataFrame:
    """One row per document: ``doc_id, path, license, similarity, origin, license_path``.

    ``origin`` is ``file`` or ``notice`` for a document's own licence, ``inherited`` for that of the nearest directory, itself
    included, that has a licence file (``license_path``), else ``none``. Of several files in a directory the most similar counts, then the
    smallest path and licence. A null or empty text has no notice; a null path has no directory and inherits nothing. Repeated rows each get
    a row; an empty table gives none; other columns are left out, so none can clash.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, "text"):
                texts = part.column("text").to_pylist()
                found = [notice(t, least) for t in texts]
                alone = [name is not None and len(WORDS.findall(t.lower())) <= n + SPARE_WORDS for t, (name, _, n) in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("path"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(alone, pa.bool_())], ["doc_id", "path", "license", "similarity", "alone"])

    kind = source.schema["doc_id"].dataType.simpleString()
    found = written(source.mapInArrow(read, f"doc_id {kind}, path string, license string, similarity double, alone boolean"), "notices")
    is_file = F.col("license").isNotNull() & (F.col("alone") | F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False)))
    found = found.withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", "")).withColumn("is_file", is_file)

    best = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("path").alias("license_path"), F.col("license").alias("l")))
    licensed = found.where("is_file and dir is not null").groupBy("dir").agg(best.alias("best")).select(F.col("dir").alias("at"), "best.license_path", F.col("best.l").alias("l"), (-F.col("best.s")).alias("s"))
    parts = F.split("dir", "/")
    above = found.where("dir is not null").select("dir").distinct().withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts)))).withColumn("at", F.array_join(F.slice(parts, 1, F.col("depth")), "/")).dropDuplicates(["dir", "at"])
    # every directory looks at the root: its key is dealt to SALT pieces, for each of which the one licensed row is there
    above = above.withColumn("salt", F.pmod(F.xxhash64("dir"), F.lit(SALT)).cast("int"))
    licensed = licensed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    inherited = above.join(licensed, ["at", "salt"]).groupBy("dir").agg(F.max_by(F.struct("license_path", "l", "s"), "depth").alias("up"))
    own = F.col("license").isNotNull()
    return found.join(inherited, "dir", "left").select(
        "doc_id", "path", F.coalesce("license", "up.l").alias("license"), F.when(own, F.col("similarity")).otherwise(F.coalesce("up.s", F.lit(0.0))).alias("similarity"),
        F.when(F.col("is_file"), "file").when(own, "notice").when(F.col("up").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(own, F.col("path")).otherwise(F.col("up.license_path")).alias("license_path"),
    )
