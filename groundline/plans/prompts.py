"""Prompts as columns. Wording is ours and a parameter; what models read off is the layout of sources and the stop tag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop tag and the turns of the model's chat format.
TAG, TAG_END = "<CERCA:", ">"
BEGIN, TURN, TURN_END, CLOSE = "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>"

SYSTEM = f"State only what your sources say. To look something up write {TAG} words to look up{TAG_END} and stop."
RESUME = f"Go on from where you stopped. Cite sources as [1], [2]. For anything else to look up, write {TAG} words{TAG_END} again."
REFINE = "Rewrite the draft as one clear answer. Keep every fact and every citation like [1]."
QUESTION = 'Write the question as JSON with the keys "subject", "predicate" and "object"; the unknown one is "?".\nQuestion: "'


def turn(role: str, text: Column | str) -> Column:
    return F.concat(F.lit(f"{TURN}{role}{TURN_END}"), F.lit(text) if isinstance(text, str) else text, F.lit(CLOSE))


def opened(*turns: Column) -> Column:
    """A chat that waits for the assistant."""
    return F.concat(F.lit(BEGIN), *turns, F.lit(f"{TURN}assistant{TURN_END}"))


def source_list(sources: Column) -> Column:
    """``[i] (Source: name)`` and the text of each source, a blank line between them. ``sources`` is an array of structs."""
    return F.array_join(F.transform(sources, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] (Source: "), F.coalesce(s["source"], F.lit("Unknown")), F.lit(")\n"), F.coalesce(s["document"], F.lit("")))), "\n\n")


def initial(question: Column, system: str = SYSTEM) -> Column:
    return opened(turn("system", system), turn("user", question))


def resumed(question: Column, partial: Column, query: Column, sources: Column, system: str = SYSTEM) -> Column:
    """The chat so far, the last search, and its results."""
    searched = F.concat(partial, F.lit(f" {TAG} "), F.coalesce(query, F.lit("unknown")), F.lit(TAG_END))
    return opened(turn("system", system), turn("user", question), turn("assistant", searched), turn("user", F.concat(F.lit("Search results:\n"), source_list(sources), F.lit(f"\n\n{RESUME}"))))


def refined(draft: Column) -> Column:
    return opened(turn("system", F.concat(F.lit(f"{REFINE}\nDraft:\n"), draft)), turn("user", "Write the answer."))


def question_slots(question: Column) -> Column:
    """Asks for a question's slots; double quotes in it become single ones."""
    return F.concat(F.lit(QUESTION), F.replace(question, F.lit('"'), F.lit("'")), F.lit('"\nJSON:'))
