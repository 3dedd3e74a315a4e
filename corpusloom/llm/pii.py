"""Personal data: regular expressions propose spans, checksums confirm them, and context words nearby adjust the score.

Every pattern is written so that its time is linear in the text: no start inside a run of digits is tried twice.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import small_batches

#: Kinds in the order that breaks ties; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone", "secret")
BASE = KINDS[:4]
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"

# The patterns of the contract, with possessive repeats where giving back never helps.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++\.[0-9]++\.[0-9]++)?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{1,4}){3,8}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: A run of what keys and tokens consist of; that it looks drawn at random is confirmed after.
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")

#: Score before context, the words that raise it and by how much; a span needs NEEDED. Base kinds start above NEEDED.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.35, "local_phone": 0.35, "secret": 0.4}
CONTEXT = {
    "email": ("mail", "e-mail", "contact"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social", "security"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax"),
    "secret": ("token", "secret", "password", "passwd", "key", "apikey", "bearer", "credential", "credentials"),
}
RAISE, NEEDED, NEAR = 0.3, 0.6, 48
_NEAR_WORDS = re.compile(r"[a-z-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064 check of an IBAN: moved to the front and letters as two digits, the number leaves 1."""
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def random_looking(run: str) -> bool:
    """Whether a run of 20 to 512 characters has letters, digits and at least ten kinds of characters."""
    return len(run) <= 512 and len(set(run)) >= 10 and any(c.isdigit() for c in run) and any(c.isalpha() for c in run)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans, base kinds first."""
    for start, end in _emails(text):
        yield "email", start, end
    digits = any(d in text for d in "0123456789")
    if not digits:
        return
    for m in _IP.finditer(text):
        if "." in (x := m[0]) and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in x.split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        if mod97(m[0]):
            yield "iban", m.start(), m.end()
    for kind, pattern in (("ssn", _SSN), ("local_phone", _LOCAL_PHONE)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()
    for m in _SECRET.finditer(text):
        if random_looking(m[0]):
            yield "secret", m.start(), m.end()


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """Spans as (kind, start, end, score) by start, then kind. Base kinds are always kept; another kind needs a score
    of NEEDED after context and no overlap with a base span. Null and empty texts have none."""
    if not text:
        return []
    found: list[tuple[str, int, int, float]] = []
    base: list[tuple[int, int]] = []
    starts: list[int] | None = None  # of the base spans in order, with the furthest end up to each
    ends: list[int] = []
    for kind, start, end in _proposed(text):
        around = f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}".lower()
        score = min(1.0, SCORES[kind] + RAISE * any(w in CONTEXT[kind] for w in _NEAR_WORDS.findall(around)))
        if kind in BASE:
            base.append((start, end))
        else:
            if score < NEEDED:
                continue
            if starts is None:
                starts, ends = [s for s, _ in sorted(base)], list(accumulate((e for _, e in sorted(base)), max))
            before = bisect_left(starts, end)
            if before and ends[before - 1] > start:
                continue
        found.append((kind, start, end, score))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def redacted(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """The text with every span, overlaps merged, replaced by its first kind in brackets."""
    if not spans:
        return text
    out, done, last = [], 0, 0
    for kind, start, end, _ in spans:
        if start >= last:
            out += [text[done:start], f"[{kind.upper()}]"]
            last = end
        last = max(last, end)
        done = last
    return "".join(out) + text[done:]


def _spans(texts: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("kind", "start", "end", "score"), x)) for x in find(t)] for t in texts])


def _redacted(texts: pd.Series) -> pd.Series:
    return pd.Series([redacted(t, find(t)) for t in texts], dtype=object)


def spans(text: Column) -> Column:
    """Array of (kind, start, end, score): code point offsets, end exclusive; empty for null."""
    return F.pandas_udf(_spans, SPANS)(text)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with personal data replaced in the text, its length column too where there is one; null stays null."""
    out = small_batches(docs).withColumn(text_col, F.pandas_udf(_redacted, "string")(F.col(text_col)))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.coalesce(F.length(text_col).cast(docs.schema[length_col].dataType), F.col(length_col)))
    return out


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, base_sha256 and spans (see the module). No row is dropped: null and empty
    texts, repeated rows and null ids have rows of their own; other columns are not read."""
    found = small_batches(docs).select(F.col(id_col).alias("_id"), spans(F.col(text_col)).alias("_spans"))
    said = lambda xs: F.concat_ws(",", F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    base = F.filter("_spans", lambda x: x["kind"].isin(*BASE))
    of_kind = lambda k: F.filter("_spans", lambda x: x["kind"] == k)
    counts = {f"n_{k}": F.size(of_kind(k)).cast("long") for k in BASE}
    return found.select(F.col("_id").alias(id_col), *[v.alias(k) for k, v in counts.items()], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("_spans")).alias("spans"))
