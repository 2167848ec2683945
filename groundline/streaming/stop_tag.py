"""Stop tags in token streams: a generation ends at the first whole tag; what it asks to look up is its query."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from groundline.functions.text import strip
from groundline.plans.prompts import TAG, TAG_END

TOKENS = "gen_id string, seq int, response string, done boolean"
OUT = "gen_id string, text string, query string, stopped boolean"


def stop_parts(full: Column) -> tuple[Column, Column, Column]:
    """Text, query and whether it stopped, of a whole generation. A tag that never closes is cut off; text without a tag stays as it is."""
    has = F.contains(full, F.lit(TAG))
    stopped = full.rlike(f"(?s){TAG}.*?{TAG_END}")
    text = F.when(has, strip(F.substring_index(full, TAG, 1))).otherwise(full)
    return text, F.when(stopped, strip(F.regexp_extract(full, f"(?s){TAG}(.*?){TAG_END}", 1))), stopped


def stop_text(full: str) -> tuple[str, str | None, bool]:
    """:func:`stop_parts` of one string."""
    head, tag, tail = full.partition(TAG)
    query, end, _ = tail.partition(TAG_END)
    return (head.strip() if tag else full), (query.strip() if end else None), bool(end)


def generations(tokens: DataFrame) -> DataFrame:
    """Batch form: ``(gen_id, text, query, stopped)`` of ``tokens(gen_id, seq, response, done)``, tokens after the first ``done`` and without a
    number left out; a missing number is a lost line."""
    tokens = tokens.where("seq is not null")
    end = tokens.where("done").groupBy("gen_id").agg(F.min("seq").alias("_end"))
    used = tokens.join(end, "gen_id", "left").where("_end is null or seq <= _end")
    whole = used.groupBy("gen_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("response", F.lit("")).alias("response")))).alias("t"))
    full = F.array_join(F.transform("t", lambda t: t["response"]), "")
    text, query, stopped = stop_parts(full)
    return whole.select("gen_id", text.alias("text"), query.alias("query"), stopped.alias("stopped"))


class StopTag(StatefulProcessor):
    """Keeps a generation's text until its first whole tag or its end, and tells it once.

    Tokens are taken up by their number. With ``wait_ms`` of 0 a number that is missing is a lost line and the next one follows, as in a stream
    that comes in order; what comes after its turn is left out. Otherwise a missing number is waited for, by processing time, and then given up.
    A generation that has had no token for ``memory_ms`` is forgotten, a finished one as well as an unfinished; without it a finished one
    leaves its mark, so that what follows tells nothing.
    """

    def __init__(self, wait_ms: int, memory_ms: int | None):
        self.wait_ms, self.memory_ms = wait_ms, memory_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("generation", "text string, turn int, finished boolean, waiting string", self.memory_ms)

    def _held(self) -> tuple[str, int, bool, dict[int, list]]:
        text, turn, finished, waiting = self.state.get() if self.state.exists() else ("", 0, False, "{}")
        return text, turn, finished, {int(k): v for k, v in json.loads(waiting).items()}

    def _advance(self, key, text: str, turn: int, held: dict[int, list], gaps: bool) -> Iterator[pd.DataFrame]:
        """Takes up held tokens, over gaps or as far as the first, and tells the generation if it ends there."""
        out = []
        while held and (gaps or turn in held) and not out:
            number = min(held)
            token, done = held.pop(number)
            text, turn = text + token, number + 1
            head, query, stopped = stop_text(text)
            if stopped or done:
                out.append((key[0], head, query, stopped))
        self.state.update(("" if out else text, turn, bool(out), "{}" if out else json.dumps(held)))
        if held and not out and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(self.now + self.wait_ms)
        yield pd.DataFrame(out, columns=["gen_id", "text", "query", "stopped"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        text, turn, finished, held = self._held()
        arrived = pd.concat(list(rows))
        if finished:
            yield pd.DataFrame([], columns=["gen_id", "text", "query", "stopped"])
            return
        for row in arrived[arrived["seq"].notna()].itertuples():
            if row.seq >= turn:
                held.setdefault(int(row.seq), [row.response or "", bool(row.done)])
        self.now = timerValues.getCurrentProcessingTimeInMs() if self.wait_ms else 0
        yield from self._advance(key, text, turn, held, self.wait_ms == 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        text, turn, finished, held = self._held()
        self.now = timerValues.getCurrentProcessingTimeInMs()
        if held and not finished:
            yield from self._advance(key, text, turn, held, True)
        else:
            yield pd.DataFrame([], columns=["gen_id", "text", "query", "stopped"])

    def close(self) -> None:
        pass


def detected(tokens: DataFrame, wait_ms: int = 0, memory_ms: int | None = None) -> DataFrame:
    """Streaming form of :func:`generations`. Needs the RocksDB state store. See :class:`StopTag` for lost and late tokens.

    ``wait_ms`` and ``memory_ms`` go by processing time, for streams that run on: with either, a run of what is available now doesn't end by
    itself.
    """
    mode = "processingTime" if wait_ms or memory_ms else "none"
    return tokens.groupBy("gen_id").transformWithStateInPandas(statefulProcessor=StopTag(wait_ms, memory_ms), outputStructType=OUT, outputMode="append", timeMode=mode)


def token_lines(lines: DataFrame) -> DataFrame:
    """Tokens of NDJSON ``lines(value)``; a line that isn't a JSON object is left out."""
    parsed = F.from_json("value", TOKENS)
    return lines.select(parsed.alias("t")).where("t is not null and t.gen_id is not null").select("t.gen_id", "t.seq", "t.response", F.coalesce("t.done", F.lit(False)).alias("done"))
