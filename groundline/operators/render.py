"""HTML of an audit: highlighted statements, whole answers, heat maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.functions.scores import alpha, level
from groundline.functions.text import escaped

# Colours and labels of the support levels.
COLOURS = {"high": "16, 185, 129", "medium": "245, 158, 11", "low": "249, 115, 22", "none": "239, 68, 68"}
BORDERS = {"high": "#10b981", "medium": "#f59e0b", "low": "#f97316", "none": "#ef4444"}
LABELS = {"high": "High Support", "medium": "Partial", "low": "Weak", "none": "Hallucination Risk"}
STYLE = "<style>.audit{line-height:1.8}.audit .fact{border-bottom:2px solid;padding:2px 6px}.audit .detail{display:none}.audit .fact:hover .detail{display:block}.heat td{padding:4px 8px;text-align:center}</style>"
EVIDENCE_CHARS, LABEL_CHARS = 400, 50


def _by_level(score: Column, values: dict[str, str]) -> Column:
    name = level(score)
    return reduce(lambda out, kv: F.when(name == kv[0], kv[1]).otherwise(out), values.items(), F.lit(None).cast("string"))


def background(score: Column) -> Column:
    return F.concat(F.lit("rgba("), _by_level(score, COLOURS), F.lit(", "), alpha(score), F.lit(")"))


def border(score: Column) -> Column:
    return _by_level(score, BORDERS)


def percent(score: Column) -> Column:
    """Whole per cent, halves to even."""
    return F.bround(score * 100, 0).cast("long").cast("string")


def cut(text: Column, size: int) -> Column:
    """``text`` up to ``size`` characters, with dots where it was longer."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def fact_html(fact: Column, score: Column, rouge: Column, exact: Column, evidence: Column, source: Column) -> Column:
    """A highlighted statement with its scores and evidence; the evidence is cut before it is escaped, so no entity is split."""
    shown = F.when(evidence != "", F.concat(F.when(source != "", F.concat(F.lit("<b>"), escaped(source), F.lit("</b>"))).otherwise(""), F.lit("<q>"), escaped(cut(evidence, EVIDENCE_CHARS)), F.lit("</q>"))).otherwise("")
    return F.concat(
        F.lit("<span class='fact' style='background:"), background(score), F.lit(";border-color:"), border(score), F.lit("'>"), escaped(fact), F.lit("<span class='detail'>"), _by_level(score, LABELS), F.lit(" "),
        percent(score), F.lit("% | ROUGE-L "), F.format_string("%.3f", F.bround(rouge, 3)), F.lit(" | match "), F.format_string("%.3f", F.bround(exact, 3)), shown, F.lit("</span></span>"),
    )


def responses(results: DataFrame, totals: DataFrame) -> DataFrame:
    """``(run_id, html)``: the statements of each run in order, under its overall score, with a legend."""
    html = fact_html(F.col("fact"), F.col("support_score"), F.col("rouge_l"), F.col("exact_match"), F.col("source_chunk_text"), F.col("best_evidence_source"))
    rows = results.select("run_id", F.struct("fact_idx", html.alias("h")).alias("f")).groupBy("run_id").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    legend = " ".join(f"<i style='color:{BORDERS[k]}'>{LABELS[k]}</i>" for k in LABELS)
    body = F.array_join(F.transform(F.coalesce("fs", F.array().cast("array<struct<fact_idx:int,h:string>>")), lambda f: f["h"]), " ")
    head = F.concat(F.lit("<div class='audit'><div>Overall: <strong style='color:"), border(F.col("overall_score")), F.lit("'>"), percent(F.col("overall_score")), F.lit("%</strong></div><p>"))
    head = F.concat(F.lit(STYLE), head)
    return totals.join(rows, "run_id", "left").select("run_id", F.concat(head, body, F.lit(f"</p><div>{legend}</div></div>")).alias("html"))


def heat_maps(facts: DataFrame, evidence: DataFrame, matrix: DataFrame) -> DataFrame:
    """``(run_id, html)``: a table of each run's matrix, facts down, sentences across; labels are escaped."""
    cell = F.concat(F.lit("<td style='background:"), background(F.col("score")), F.lit("'>"), F.format_string("%.2f", F.bround("score", 2)), F.lit("</td>"))
    row = matrix.select("run_id", "fact_idx", F.struct("ev_idx", cell.alias("h")).alias("c")).groupBy("run_id", "fact_idx").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    line = facts.join(row, ["run_id", "fact_idx"], "left").select("run_id", F.struct("fact_idx", F.concat(F.lit("<tr><th title='"), escaped(F.col("fact")), F.lit("'>"), escaped(cut(F.col("fact"), LABEL_CHARS)), F.lit("</th>"), F.coalesce(F.array_join(F.transform("cs", lambda c: c["h"]), ""), F.lit("")), F.lit("</tr>")).alias("h")).alias("l"))
    head = evidence.select("run_id", F.struct("ev_idx", F.concat(F.lit("<th title='"), escaped(F.col("sentence")), F.lit("'>E"), (F.col("ev_idx") + 1).cast("string"), F.lit("</th>")).alias("h")).alias("e")).groupBy("run_id").agg(F.array_sort(F.collect_list("e")).alias("es"))
    body = line.groupBy("run_id").agg(F.array_sort(F.collect_list("l")).alias("ls")).join(head, "run_id", "left")
    join = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["h"]), ""), F.lit(""))
    return body.select("run_id", F.concat(F.lit(f"{STYLE}<table class='heat'><tr><th></th>"), join("es"), F.lit("</tr>"), join("ls"), F.lit("</table>")).alias("html"))
