"""Column functions on text: white space, chunk windows, sentences, cleaning, rendering, questions and slots."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every character that counts as white space in Unicode text, for Java's regular expressions.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

#: The same characters, one after another.
SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# Question starters, each followed by a blank.
QUESTION_STARTERS = (
    "chi", "cosa", "che cosa", "che", "quale", "quali", "quando", "dove", "come", "perché", "perche", "quanto",
    "who", "what", "where", "when", "why", "how", "which",
)

# Strings that stand for a missing value.
MISSING = ("none", "nan", "null", "")


def strip(text: Column) -> Column:
    """``text`` without white space at its ends; Spark's own trim knows blanks only."""
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """The runs of non-space characters of ``text``."""
    return F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != "")


def normalized(name: Column) -> Column:
    """Key of an entity: lower case, stripped."""
    return F.lower(strip(name))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use`` names it or loops over it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_windows(text: Column, size: int = 200, overlap: int = 50) -> Column:
    """Windows of ``size`` words, each ``size - overlap`` after the last, joined by blanks; a short last window is kept."""
    stride = max(1, size - overlap)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(stride)), lambda i: F.array_join(F.slice(w, i + 1, size), " "))

    return bound(words(text), lambda w: F.when(F.size(w) > 0, windows(w)).otherwise(F.array().cast("array<string>")))


def char_windows(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Windows of ``size`` characters, stripped, without blank ones. A text of white space alone has none.

    The text is cut once into pieces of ``size - overlap`` characters; a window is its piece and the beginning of the next ones,
    so the work is linear in the text.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    more = -(-size // step)

    def windows(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: strip(F.substring(F.array_join(F.slice(p, i, more), ""), F.lit(1), F.lit(size))))

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    return F.when(F.length(strip(text)) > 0, F.filter(bound(cut, windows), lambda p: p != "")).otherwise(F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Sentences, stripped, without blank ones: a sentence ends in ``.``, ``!`` or ``?`` before white space."""
    marked = F.regexp_replace(text, r"([.!?])[ \t\n\r]+", F.concat(F.lit("$1"), F.char(F.lit(1))))
    return F.filter(F.transform(F.split(marked, "\x01"), strip), lambda s: s != "")


def atomic_facts(text: Column, least_words: int = 3) -> Column:
    """Sentences of at least ``least_words`` words."""
    return F.filter(sentences(text), lambda s: F.size(words(s)) >= least_words)


def chunked(docs: DataFrame, windows: Column, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, a row per window: its ``chunk_index`` from 0 and the chunk as ``text``."""
    return docs.select(*(c for c in docs.columns if c != text), F.posexplode(windows).alias("chunk_index", text))


def cleaned(value: Column, default: str = "") -> Column:
    """``value`` as stripped text; nulls and words that mean missing become ``default``."""
    s = strip(value.cast("string"))
    return F.when(s.isNull() | F.lower(s).isin(*MISSING), F.lit(default)).otherwise(s)


def first_present(df: DataFrame, names: Sequence[str], default: Column) -> Column:
    """The first of ``names`` that ``df`` has as a column; its nulls stay. ``default`` where it has none of them."""
    return next((F.col(f"`{n}`").cast("string") for n in names if n in df.columns), default)


def rendered(groups: Sequence[Mapping[str, Column]], tail: Sequence[tuple[str, Column, str]], title: Column, titles: Sequence[tuple[str, Column]]) -> Column:
    """A row as labelled text: the title and other titles, groups of ``Label: value`` joined by full stops, then ``tail``.

    Values are cleaned columns; an empty one is left out with its label, an empty group altogether, and another title where it
    equals the title.
    """
    def named(label: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"{label}: "), value))

    head = F.concat_ws(" ", F.concat(F.lit("Title: "), title, F.lit(".")), *(F.when((v != "") & (v != title), F.concat(F.lit(f"{k}: "), v, F.lit("."))) for k, v in titles))
    body = []
    for group in groups:
        joined = F.concat_ws(". ", *(named(k, v) for k, v in group.items()))
        body.append(F.when(joined != "", F.concat(joined, F.lit("."))))
    return strip(F.concat_ws(" ", head, *body, *(F.concat(named(k, v), F.lit(end)) for k, v, end in tail)))


def is_question(text: Column) -> Column:
    """Whether a stripped text ends in a question mark or begins with a question word and a blank."""
    low = F.lower(strip(text))
    return low.endswith("?") | low.rlike("^(?:" + "|".join(QUESTION_STARTERS) + ") ")


def slots(raw: Column) -> Column:
    """``struct(subject, predicate, object)`` of the first braces in a model's answer; null where unknown or not valid JSON.

    Braces end at the first closing one, so nested objects are no valid answer. A slot that isn't a string is taken as text.
    """
    found = F.from_json(F.regexp_extract(raw, r"(?s)\{.*?\}", 0), "subject string, predicate string, object string")

    def slot(name: str) -> Column:
        s = strip(found[name])
        return F.when(s.isNull() | F.lower(s).isin("null", "", "?"), None).otherwise(s)

    return F.struct(*(slot(n).alias(n) for n in ("subject", "predicate", "object")))


def slot_facts(spec: Column) -> tuple[Column, Column, Column]:
    """Number of known slots, whether all are known, and the unknown slot's name where it is the only one."""
    names = ("subject", "predicate", "object")
    known = sum((spec[n].isNotNull().cast("int") for n in names), F.lit(0))
    unknown = F.when(known == 2, F.coalesce(*(F.when(spec[n].isNull(), F.lit(n)) for n in names)))
    return known, known == 3, unknown


def chunk_id(title: Column, index: Column) -> Column:
    """Key of a chunk in a vector collection."""
    return F.md5(F.concat(title, F.lit("_"), index.cast("string")).cast("binary"))


def source_id(source: Column, index: Column) -> Column:
    return F.concat(source, F.lit("_chunk"), index.cast("string"))


def escaped(text: Column) -> Column:
    """HTML text."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text
