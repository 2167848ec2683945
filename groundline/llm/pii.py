"""Personal data: candidate spans from high-recall generators, scored by gradient-boosted trees, cut at calibrated thresholds.

Generators propose overlapping spans: addresses in other scripts or in disguise, runs of digits and separators and the numbers
that may stand side by side in one, colon and bracketed host addresses, identifiers, assigned secrets, keys of known forms and
long mixed tokens. Trees see a candidate's format (digits, groups, separators, check sums, entropy) and its context (cue words
before it, the characters around it). The training candidates are split in four: one part fits the trees, one their
calibration, one the thresholds, and the last measures. Each kind's threshold is the calibrated score of the best F1 on the
third part among those that keep its precision there. The base patterns are always redacted; the model adds spans beside them.

The training candidates are made up from templates, ``TRAIN_ROWS`` of them by a fixed seed: no labelled personal data exists
here, and none is wanted.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm.boosting import Boosted
from groundline.llm.common import fields_of, numbered_names, parts_of, unused

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "id", "secret")
TRAIN_ROWS, PRECISION = 6000, 0.98
#: Shares of the training candidates, in fifths: fit, calibration, thresholds, measurement.
PARTS = (2, 1, 1, 1)
CONTEXT = 40

# Possessive forms of the base patterns: they match the same spans and never back up over a long run.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

NUMBERS = re.compile(r"[+(]?[0-9][0-9 ./()-]*+")
OBFUSCATED = re.compile(r"(?<![\w.%+-])[\w.%+-]++\s?[\[(]\s?at\s?[\])]\s?[\w-]+(?:\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[\w-]+)+", re.I)
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
UNICODE_MAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]++@[\w-]++(?:\.[\w-]++)+")
SPELT = re.compile(r"(?<![\w.%+-])[\w.%+-]++ (?:at|AT) [\w-]++ (?:dot|DOT) [a-z]{2,6}\b")
COLONS = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
DEFANGED = re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3}(?!\w)")
KEY_FORM = re.compile(r"(?<!\w)(?:A[KS]IA[0-9A-Z]{16}(?!\w)|gh[pousr]_\w{20,}|sk-[\w-]{20,}|xox[abprs]-[\w-]{10,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]+)")
MIXED = re.compile(r"(?<![\w/+=-])[A-Za-z0-9+/_=-]{24,}+(?!\w)")
PEM_BEGIN, PEM_END = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), "PRIVATE KEY-----"
#: Neighbouring groups of a long run of digits that may be one number.
GROUPS = 5
ASSIGNED = re.compile(r"[\"']?\s{0,2}[=:]\s{0,2}[\"']?([^\s\"',;<>]{8,})")
NAME_BEFORE = re.compile(r"([A-Za-z][\w-]{0,30})[\"']?\s{0,2}$")
CUES = {
    "email": "mail contact write address correo courriel", "phone": "phone call tel mobile cell fax telefon ring sms whatsapp", "card": "card visa credit debit payment karte carte tarjeta",
    "ip": "ip host server address login from client", "id": "ssn social passport iban account tax national steuer konto identity", "secret": "token secret password passwd key pwd credential auth",
    "not": "version order isbn page figure total price invoice item build release id number no ref serial",
}
CUE_SETS = {k: re.compile(r"(?:^|[^a-z])(?:" + "|".join(v.split()) + r")[^a-z]{0,6}(?:[a-z]{1,6}[^a-z]{0,3})?$") for k, v in CUES.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the base patterns, by start and then kind as listed. Candidates that fail are dropped, not retried."""
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end(), 0))
            last = m.end()
        at = text.find("@", at + 1)
    if DIGIT.search(text):
        found += [(*m.span(), 1) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((*m.span(), 2))
        if "+" in text:
            found += [(*m.span(), 3) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(s, e, BASE_KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Overlapping proposals beside the base patterns: more than will be kept."""
    found = set()
    if DIGIT.search(text):
        for m in NUMBERS.finditer(text):
            run = m[0].rstrip(" ./(-")
            n = sum(c.isdigit() for c in run)
            if n < 7:
                continue
            start, end = m.start(), m.start() + len(run)
            if 7 <= n <= 15:
                found.add((start, end, "phone"))
            if 12 <= n <= 19:
                found.add((start, end, "card"))
            if n in (9, 11):
                found.add((start, end, "id"))
            if " " in run:  # pieces of a run that may hold more than one number
                for p in re.finditer(r"[^ ]+", run):
                    k = sum(c.isdigit() for c in p[0])
                    if 7 <= k <= 19:
                        found.add((start + p.start(), start + p.end(), "card" if k >= 12 else "phone"))
            if n > 19:  # numbers side by side: neighbouring groups of it
                places = [(g.start(), g.end()) for g in re.finditer(r"[^ ]+", run)]
                if max(e - s for s, e in places) >= 3:
                    for i in range(len(places)):
                        for j in range(i + 1, min(i + GROUPS, len(places))):
                            piece = run[places[i][0]:places[j][1]]
                            k = sum(c.isdigit() for c in piece)
                            if 7 <= k <= 19:
                                found.add((start + places[i][0], start + places[j][1], "card" if k >= 13 else "phone"))
        found |= {(*m.span(), "id") for m in IBAN.finditer(text)}
        found |= {(*m.span(), "ip") for m in DEFANGED.finditer(text)} if "[" in text or "(" in text else set()
        found |= {(*m.span(), "secret") for m in MIXED.finditer(text) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])}
        found |= {(*m.span(), "secret") for m in KEY_FORM.finditer(text)}
    if text.count(":") > 1:
        found |= {(*m.span(), "ip") for m in COLONS.finditer(text) if len(m[0]) > 4}
    if not text.isascii() and "@" in text:
        found |= {(*m.span(), "email") for m in UNICODE_MAIL.finditer(text) if not m[0].isascii()}
    if " at " in text or " AT " in text:
        found |= {(*m.span(), "email") for m in SPELT.finditer(text)}
    if "PRIVATE KEY-----" in text:
        at = 0
        while m := PEM_BEGIN.search(text, at):
            end = text.find(PEM_END, m.end())
            if end < 0:
                break
            at = end + len(PEM_END)
            found.add((m.start(), at, "secret"))
    low = text.lower() if "(" in text or "[" in text else ""
    if "at)" in low or "at]" in low or "at )" in low or "at ]" in low:
        found |= {(*m.span(), "email") for m in OBFUSCATED.finditer(text)}
    for sign in "=:":
        at = text.find(sign)
        while at >= 0:
            name = NAME_BEFORE.search(text[max(0, at - 36):at])
            if name and (m := ASSIGNED.match(text, at)):
                found.add((*m.span(1), "secret"))
                at = m.end() - 1
            at = text.find(sign, at + 1)
    return sorted(found)


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context of one candidate."""
    s = text[start:end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    groups = re.findall(r"[0-9]+", s)
    before = text[max(0, start - CONTEXT):start].lower()
    around = (text[start - 1] if start else " ") + (text[end] if end < len(text) else " ")
    counts = Counter(s)
    entropy = -sum(c / len(s) * math.log2(c / len(s)) for c in counts.values())
    hexes = sum(c in "0123456789abcdefABCDEF" for c in s)
    return [
        *(float(kind == k) for k in KINDS), len(s), len(digits), len(digits) / len(s), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        s.count(" "), s.count("."), s.count("-"), s.count("/"), s.count("("), float(s[0] == "+"), float(bool(digits) and luhn(digits)), float(len(counts)), entropy, hexes / len(s),
        sum(c.isupper() for c in s) / len(s), float(groups[0][0] in "3456") if groups else 0.0, float(around[0].isalnum()), float(around[1].isalnum()), float(around[0] in "\"'"), float(around[0] == "\n" or around[0] == " "),
        float(iban_ok(s)), float([len(g) for g in groups] == [3, 2, 4]), s.count(":"), float(ip_ok(s)), float(bool(KEY_FORM.fullmatch(s)) or s.startswith("-----BEGIN")), s.count("@"), float(" dot " in s.lower() or "[dot]" in s.lower()),
        sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False)) / len(s), *(float(bool(p.search(before))) for p in CUE_SETS.values()),
    ]


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ip_ok(s: str) -> bool:
    """Whether it is an IPv6 address, or an IPv4 one in brackets' disguise."""
    try:
        ipaddress.ip_address(re.sub(r"\[dot\]|[\[(]\.[\])]", ".", s))
    except ValueError:
        return False
    return True


def _made_up(rng: random.Random) -> tuple[str, int, int, str, int]:
    """A training candidate in its text: start, end, kind, label."""
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "re", "in", "ed", "nd", "ge", "le", "es", "ou")) for _ in range(rng.randint(1, 4)))
    filler = lambda: " ".join(word() for _ in range(rng.randint(2, 8)))
    cue = lambda k: rng.choice(CUES[k].split())
    with_luhn = lambda d: d[:-1] + next(c for c in "0123456789" if luhn(d[:-1] + c))
    kind, label = rng.choice(KINDS), rng.randint(0, 1)
    lead = filler() + rng.choice((". ", " ", "\n"))
    if kind == "phone":
        value = rng.choice((f"({digit(3)}) {digit(3)}-{digit(4)}", f"{digit(3)}-{digit(3)}-{digit(4)}", f"0{digit(2)} {digit(4)} {digit(4)}", f"00{digit(2)} {digit(3)} {digit(6)}")) if label else rng.choice((digit(8), digit(7), f"{digit(4)}-{digit(4)}", f"20{digit(2)}-0{rng.randint(1, 9)}-1{digit(1)}", digit(10), f"{digit(3)}.{digit(3)}.{digit(4)}"))
        lead += f"{cue('phone')}{rng.choice((': ', ' ', ' at '))}" if label and rng.random() < 0.8 else f"{cue('not')} " if not label and rng.random() < 0.6 else ""
    elif kind == "card":
        d = with_luhn(rng.choice("3456") + digit(rng.choice((14, 15, 15, 15)))) if label else digit(rng.choice((12, 13, 14, 16, 18)))
        value = rng.choice((d, " ".join(d[i:i + 4] for i in range(0, len(d), 4)), d))
        lead += f"{cue('card')} " if label and rng.random() < 0.7 else f"{cue('not')} " if not label and rng.random() < 0.6 else ""
    elif kind == "ip":
        part = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(1, n)))
        six = rng.choice((":".join(part(4) for _ in range(8)), f"{part(4)}:{part(4)}::{part(4)}", f"fe80::{part(4)}:{part(4)}:{part(4)}", f"2001:db8::{part(4)}"))
        four = rng.choice(("[.]", "(.)", "[dot]")).join(str(rng.randint(0, 255)) for _ in range(4))
        value = rng.choice((six, six, four)) if label else rng.choice((f"{rng.randint(0, 23)}:{digit(2)}:{digit(2)}", ":".join(part(2).zfill(2) for _ in range(6)), f"{digit(1)}:{digit(1)}:{digit(1)}", f"{digit(2)}:{digit(2)}:{digit(2)}:{digit(2)}", "[.]".join(digit(3) for _ in range(4)).replace("[.]", "[.]9", 1)))
        lead += f"{cue('ip')} " if label and rng.random() < 0.6 else f"{cue('not')} " if not label and rng.random() < 0.5 else ""
    elif kind == "email":
        host = f"{word()}.{rng.choice(('com', 'org', 'net', 'de'))}"
        value = rng.choice((f"{word()}{digit(2)} [at] {word()} [dot] {rng.choice(('com', 'org', 'net'))}", f"{word()}.{word()}@{word()}é{host}", f"ü{word()}@{host}", f"{word()}{digit(1)} at {word()} dot com", f"{word()}.{word()} AT {word()} DOT org"))
        if not label:
            value = rng.choice((f"{word()} (at) {word()}.{word()}ing", f"{word()} at {word()} dot {word()[:4]}", f"ü{word()}@{word()}.{word()}.{digit(3)}"))
        lead += f"{cue('email')} " if label and rng.random() < 0.5 else ""
    elif kind == "id":
        country = rng.choice(("DE", "FR", "ES", "GB"))
        body = digit(18)
        check = 98 - int(body + "".join(str(int(c, 36)) for c in country) + "00") % 97
        value = rng.choice((f"{digit(3)}-{digit(2)}-{digit(4)}", f"{country}{check:02d}{body}")) if label else rng.choice((digit(9), digit(11), f"{country}{digit(20)}", f"{digit(4)}-{digit(5)}"))
        lead += f"{cue('id')}{rng.choice((': ', ' '))}" if label and rng.random() < 0.8 else f"{cue('not')} " if not label and rng.random() < 0.5 else ""
    else:
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        drawn = lambda n, some: "".join(rng.choice(some) for _ in range(n))
        bare = rng.random() < 0.4
        if label:
            value = rng.choice((f"AKIA{drawn(16, letters[:26] + '0123456789')}", f"ghp_{drawn(36, letters)}", f"sk-{drawn(rng.randint(24, 48), letters)}", drawn(rng.choice((32, 40, 44)), letters + "+/"))) if bare else drawn(rng.choice((16, 20, 32, 40)), rng.choice(("0123456789abcdef", letters + "+/_-")))
        else:
            value = rng.choice((word() * 3, f"{word()}/{word()}/{word()}", f"{word()}-{word()}-{word()}", f"//{word()}.{word()}.com/{word()}"))
            if bare:
                value = rng.choice((f"{'-'.join(word() for _ in range(7))}-{digit(4)}", f"/{'/'.join(word() for _ in range(6))}/{digit(2)}", f"{'_'.join(word() for _ in range(7))}_{digit(1)}", "=" * 24 + digit(2) + word(), "".join(word().title() for _ in range(7)) + digit(2), f"{digit(4)}-{digit(2)}-{digit(2)}T{digit(2)}-{digit(2)}-{digit(2)}-{word()}{word()}"))
        if not bare:
            lead += (f"{cue('secret')}{rng.choice((' = ', '=', ': '))}" if label else f"{word()}{rng.choice((' = ', ':', ': '))}") + rng.choice(('"', "", "'"))
    return lead + value + rng.choice((" ", ". ", '"', "\n")) + filler(), len(lead), len(lead) + len(value), kind, label


def _parts(rows: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels, kinds and parts of the made-up candidates."""
    rng = random.Random(seed)
    made = [_made_up(rng) for _ in range(rows)]
    deal = np.repeat(np.arange(len(PARTS)), PARTS)
    return np.array([features(t, s, e, k) for t, s, e, k, _ in made]), np.array([m[4] for m in made], float), np.array([m[3] for m in made]), deal[np.arange(rows) % len(deal)]


@cache
def model(rows: int = TRAIN_ROWS, seed: int = 11) -> tuple[Boosted, dict[str, float]]:
    """The trained trees and each kind's threshold. The same on every machine; fitted on ``rows`` made-up candidates."""
    x, y, kinds, part = _parts(rows, seed)
    trees = Boosted().fit(x[part == 0], y[part == 0]).calibrate(x[part == 1], y[part == 1])
    limits = {}
    for kind in KINDS:
        own = (part == 2) & (kinds == kind)
        p, truth = trees.probability(x[own]), y[own]
        order = np.argsort(-p, kind="stable")
        right, n = np.cumsum(truth[order]), np.arange(1, len(p) + 1)
        f1 = np.where(right / n >= PRECISION, 2 * right / (n + truth.sum()), 0.0)
        k = int(np.argmax(f1)) if len(p) else 0
        scores = np.r_[p[order], 0.0]
        limits[kind] = float((scores[k] + scores[k + 1]) / 2) if len(p) and f1[k] > 0 else 1.1
    return trees, limits


def measured(rows: int = TRAIN_ROWS, seed: int = 11) -> dict[str, tuple[float, float]]:
    """Precision and recall of each kind on the part of the candidates that nothing was fitted to."""
    trees, limits = model(rows, seed)
    x, y, kinds, part = _parts(rows, seed)
    out = {}
    for kind in KINDS:
        own = (part == 3) & (kinds == kind)
        said, truth = trees.probability(x[own]) >= limits[kind], y[own] > 0
        out[kind] = float((said & truth).sum() / max(1, said.sum())), float((said & truth).sum() / max(1, truth.sum()))
    return out


def redactions(texts: list[str], trees: Boosted, limits: dict[str, float]) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """For each text its base spans and all its spans. Of overlapping additions the likelier stays; base spans always do."""
    base = [base_spans(t) for t in texts]
    proposed = [candidates(t) for t in texts]
    flat = [(i, c) for i, some in enumerate(proposed) for c in some]
    p = trees.probability(np.array([features(texts[i], *c) for i, c in flat])) if flat else []
    chosen, taken = [list(b) for b in base], {}
    for _, i, (s, e, kind) in sorted((-p[n], i, c) for n, (i, c) in enumerate(flat) if p[n] >= limits[c[2]]):
        if i not in taken:
            taken[i] = bytearray(len(texts[i]))
            for s2, e2, _ in base[i]:
                taken[i][s2:e2] = b"\1" * (e2 - s2)
        if not any(taken[i][s:e]):
            chosen[i].append((s, e, kind))
            taken[i][s:e] = b"\1" * (e - s)
    order = {k: n for n, k in enumerate(KINDS)}
    return [(b, sorted(c, key=lambda x: (x[0], order[x[2]], x[1]))) for b, c in zip(base, chosen, strict=True)]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by its kind in capitals."""
    out, p = [], 0
    for s, e, kind in sorted(spans):
        if s >= p:
            out += [text[p:s], f"[{kind.upper()}]"]
        p = max(p, e)
    return "".join([*out, text[p:]])


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: its id, ``n_email, n_ip, n_card, n_phone, base_sha256, spans`` and the ``redacted`` text.

    Offsets are code points, ends exclusive. The base counts and digest cover the base patterns alone; ``spans`` also has what
    the model adds. A null text is an empty one, without spans. Texts of any length are searched whole. Repeated rows each get
    a row; an empty table gives none; other columns are left out, so none can clash.
    """
    found, names = search_pii(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", ("doc_id",))
    told = dict(zip((x.split()[0] for x in FOUND.split(", ")), names, strict=True))
    return found.select("doc_id", *(F.col(n).alias(c) for c, n in told.items() if with_text or c != "redacted"))


def redact_documents(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with their texts redacted and ``length_col``, if there is one, set to the new length. A null text stays null, an empty one
    empty. All columns are kept, of any names; repeated rows each get a row; an empty table gives none."""
    plain, own = numbered_names(docs)
    found, names = search_pii(plain, own[text_col], tuple(plain.columns))
    has, redacted = F.col(own[text_col]).isNotNull(), F.col(names[-1])
    new = {text_col: F.when(has, redacted)}
    if length_col in own:
        new[length_col] = F.when(has, F.length(redacted)).otherwise(F.col(own[length_col])).cast(docs.schema[length_col].dataType)
    return found.select(*(new[c].alias(n) if c in new else n for c, n in own.items())).toDF(*docs.columns)


def search_pii(docs: DataFrame, text_col: str, carry: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """``carry`` of ``docs`` with the columns of ``FOUND``, and the names that those have here."""
    trees, limits = model()
    names = unused(docs.columns, *(x.split()[0] for x in FOUND.split(", ")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, text_col):
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                found = redactions(texts, trees, limits)
                counts = [Counter(k for _, _, k in b) for b, _ in found]
                columns = [
                    *[pa.array([c[k] for c in counts], pa.int64()) for k in BASE_KINDS], pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string()),
                    pa.array([joined(a) for _, a in found], pa.string()), pa.array([redact(t, a) for t, (_, a) in zip(texts, found, strict=True)], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *columns], [*carry, *names])

    source = docs.select(*dict.fromkeys([*carry, text_col]))
    kinds = ", ".join(f"{n} {x.split()[1]}" for n, x in zip(names, FOUND.split(", "), strict=True))
    return source.mapInArrow(search, f"{fields_of(docs.select(*carry))}, {kinds}"), names
