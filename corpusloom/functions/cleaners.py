"""Text cleaners and tokenizers by name, as columns. Rules that columns can express stay in the engine; the others run
in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# How digits and letters are read in Korean.
KOREAN = {
    "0": "영", "1": "일", "2": "이", "3": "삼", "4": "사", "5": "오", "6": "육", "7": "칠", "8": "팔", "9": "구",
    "A": "에이", "B": "비", "C": "씨", "D": "디", "E": "이", "F": "에프", "G": "지", "H": "에이치", "I": "아이", "J": "제이", "K": "케이", "L": "엘", "M": "엠",
    "N": "엔", "O": "오", "P": "피", "Q": "큐", "R": "알", "S": "에스", "T": "티", "U": "유", "V": "브이", "W": "더블유", "X": "엑스", "Y": "와이", "Z": "지",
}
# Abbreviations that English readers spell out.
ABBREVIATIONS = {
    "mrs": "misess", "mr": "mister", "dr": "doctor", "st": "saint", "co": "company", "jr": "junior", "maj": "major", "gen": "general", "drs": "doctors",
    "rev": "reverend", "lt": "lieutenant", "hon": "honorable", "sgt": "sergeant", "capt": "captain", "esq": "esquire", "ltd": "limited", "col": "colonel", "ft": "fort",
}
CONTRACTIONS = {"won't": "will not", "can't": "can not", "n't": " not", "'re": " are", "'ll": " will", "'ve": " have", "'m": " am", "let's": "let us"}
_UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def spoken(n: int) -> str:
    """A whole number in English words."""
    if n < 0:
        return f"minus {spoken(-n)}"
    if n < 20:
        return _UNITS[n]
    if n < 100:
        return _TENS[n // 10 - 2] + (f" {_UNITS[n % 10]}" if n % 10 else "")
    for size, name in ((10**12, "trillion"), (10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred")):
        if n >= size:
            rest = n % size
            return f"{spoken(n // size)} {name}" + (f" {spoken(rest)}" if rest else "")
    raise AssertionError


def _number(m: re.Match) -> str:
    digits = m[0].replace(",", "")
    return spoken(int(digits)) if len(digits) <= 15 else " ".join(_UNITS[int(d)] for d in digits)


def tacotron(text: str) -> str:
    """ASCII without accents and brackets, numbers, abbreviations and & spelt out, dashes as spaces, semicolons and
    colons as commas, upper case."""
    flat = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    flat = re.sub(r"[0-9]+(?:,[0-9]{3})*", _number, flat)
    flat = re.sub(r"\b(" + "|".join(ABBREVIATIONS) + r")\.", lambda m: ABBREVIATIONS[m[1]], flat)
    flat = re.sub(r"[()\[\]<>\"]", "", flat).replace("&", " and ").replace("-", " ").replace(";", ",").replace(":", ",")
    return re.sub(r"\s+", " ", flat).strip().upper()


def whisper_basic(text: str) -> str:
    """Lower case, without what stands in brackets, marks, symbols and punctuation as spaces."""
    flat = re.sub(r"[<\[][^>\]]*[>\]]", "", text.lower())
    flat = re.sub(r"\(([^)]+?)\)", "", flat)
    flat = "".join(" " if unicodedata.category(c)[0] in "MSP" else c for c in unicodedata.normalize("NFKC", flat))
    return re.sub(r"\s+", " ", flat)


def whisper_en(text: str) -> str:
    """As whisper_basic, after fillers are left out and contractions are written in full; digits stay."""
    flat = re.sub(r"\b(?:hmm|mm|mhm|mmm|uh|um)\b", "", text.lower().replace("’", "'"))
    for short, full in CONTRACTIONS.items():
        flat = re.sub((r"\b" if short[0].isalpha() and short != "n't" else "") + re.escape(short) + r"\b", full, flat)
    return whisper_basic(flat).strip()


def _each(f: Callable[[str], str]) -> Callable[[Column], Column]:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action="ignore")

    return lambda text: F.pandas_udf(run, "string")(text)


def korean(text: Column) -> Column:
    """Digits and Latin letters as they are read in Korean."""
    said = F.create_map(*[F.lit(x) for pair in KOREAN.items() for x in pair])
    chars = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "")
    return F.array_join(F.transform(chars, lambda c: F.coalesce(F.try_element_at(said, F.when((c >= "a") & (c <= "z"), F.upper(c)).otherwise(c)), c)), "")


CLEANERS: dict[str, Callable[[Column], Column]] = {
    "tacotron": _each(tacotron),
    "jaconv": _each(lambda t: unicodedata.normalize("NFKC", t)),
    "vietnamese": _each(lambda t: unicodedata.normalize("NFC", t).lower()),
    "korean_cleaner": korean,
    "whisper_en": _each(whisper_en),
    "whisper_basic": _each(whisper_basic),
}


def cleaned(text: Column, names: list[str]) -> Column:
    """A text after the named cleaners, one after another; null stays null."""
    for name in names:
        if name not in CLEANERS:
            raise ValueError(f"no cleaner is named {name!r}, only {', '.join(CLEANERS)}")
    return reduce(lambda t, name: CLEANERS[name](t), names, text)


@lru_cache(4)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(4)
def _vocabulary(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _modelled(encode: Callable[[list[str]], list[list[str]]]) -> Callable[[Column], Column]:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(encode(texts.fillna("").tolist()), dtype=object)

    return lambda text: F.when(text.isNotNull(), F.pandas_udf(run, "array<string>")(text))


def tokens(text: Column, kind: str, model: str | None = None, delimiter: str | None = None, lexicon: dict[str, list[str]] | None = None) -> Column:
    """Tokens by a kind of tokenizer: word, char, jaso (letters and marks of the characters), phn (phones by the lexicon, or parted by spaces), bpe (a piece model),
    hugging_face, whisper or qwen2audio (a tokenizer file). The last three need the path of their file."""
    if kind == "word":
        return T.words(text, delimiter)
    if kind == "char":
        return T.chars(text)
    if kind == "jaso":
        apart = _each(lambda t: unicodedata.normalize("NFKD", t))
        return T.chars(apart(text))
    if kind == "phn":
        parts = T.words(text)
        if not lexicon:
            return parts
        said = F.create_map(*[x for w, phones in lexicon.items() for x in (F.lit(w), F.array(*[F.lit(p) for p in phones]))])
        return F.flatten(F.transform(parts, lambda w: F.coalesce(F.try_element_at(said, w), F.array(F.lit("<unk>")))))
    if kind in ("bpe", "hugging_face", "whisper", "qwen2audio"):
        if model is None:
            raise ValueError(f"a tokenizer of kind {kind!r} needs a model file")
        if kind == "bpe":
            return _modelled(lambda ts: _pieces(model).encode(ts, out_type=str, num_threads=1))(text)
        return _modelled(lambda ts: [e.tokens for e in _vocabulary(model).encode_batch(ts, add_special_tokens=False)])(text)
    raise ValueError(f"no tokenizer is of kind {kind!r}")


def text_of_pieces(pieces: Column, model: str) -> Column:
    """The text that pieces of a piece model make."""

    def run(xs: pd.Series) -> pd.Series:
        return pd.Series([_pieces(model).decode(list(x)) for x in xs], dtype=object)

    return F.pandas_udf(run, "string")(pieces)
