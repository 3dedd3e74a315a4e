"""Text functions as columns: tokenisers, cleaners, error counts, quality predicates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\f\x0B]+"


def chars(text: Column, space: str = "<space>") -> Column:
    """Characters as tokens, a space by name; no tokens of an empty text."""
    return F.filter(F.transform(F.split(text, ""), lambda c: F.when(c == " ", space).otherwise(c)), lambda c: c != "")


def chars_to_text(tokens: Column, space: str = "<space>") -> Column:
    return F.array_join(F.transform(tokens, lambda c: F.when(c == space, " ").otherwise(c)), "")


def words(text: Column, delimiter: str | None = None) -> Column:
    """Words between white space; a blank text has none. Between delimiters, empty words stay."""
    if delimiter is not None:
        return F.split(text, delimiter)
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def split_words(text: str) -> list[str]:
    """A text between runs of spaces and line ends, as a split by [ \\n]+ gives it, though in another order: empty words
    stand for a run at an end, and for an empty text."""
    ends = text[:1] in ("", " ", "\n"), text[-1:] in (" ", "\n")
    return [w for w in text.replace("\n", " ").split(" ") if w] + [""] * sum(ends)


def without_punctuation(text: Column) -> Column:
    """No punctuation but apostrophes and <space>; spaces squeezed."""
    held = F.replace(text, F.lit("<space>"), F.lit("\ue000"))
    bare = F.regexp_replace(held, r"[\p{Punct}\p{P}&&[^']]", "")
    return F.trim(F.regexp_replace(F.replace(bare, F.lit("\ue000"), F.lit("<space>")), " +", " "))


def ngrams(text: Column, n: int) -> Column:
    """Character n-grams one after another, the last one shorter if need be."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text), F.lit(n)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


#: Distinct words that a pair can have: characters from U+0100 on but surrogates.
MOST_WORDS = 0x110000 - 0x100 - 0x800


def _letters(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Each pair as two texts that have one character for each distinct word of the pair."""
    out: list[list[str | None]] = [[], []]
    for pair in zip(ref, hyp):
        known: dict = {}
        for words_, said in zip(pair, out):
            if words_ is None:
                said.append(None)
                continue
            ids = [known.setdefault(w, len(known)) for w in words_]
            if len(known) > MOST_WORDS:
                raise ValueError(f"a pair of texts has more than {MOST_WORDS} distinct words")
            said.append("".join(chr(i + 0x100 if i < 0xD700 else i + 0x900) for i in ids))
    return pd.DataFrame({"ref": out[0], "hyp": out[1]})


def word_errors(ref: Column, hyp: Column) -> Column:
    """Edit distance of two word arrays: each distinct word of the pair becomes one character, once, so that the
    built-in distance of texts, which is compiled, does the work. Fails beyond MOST_WORDS distinct words in a pair."""
    said = F.pandas_udf(_letters, "ref string, hyp string")(ref, hyp)
    return F.levenshtein(said["ref"], said["hyp"])


#: Product of two texts' lengths from which bits in Python are faster than the built-in distance.
BITS_FROM = 40_000


def edit_distance(a: str, b: str) -> int:
    """Edit distance of two texts, a column of the table of all pairs at once as the bits of whole numbers (Myers,
    Hyyro). A text that the other one holds in order is as far as it is shorter."""
    if len(a) < len(b):
        a, b = b, a
    if in_order(b, a):
        return len(a) - len(b)
    at, bit = {}, 1
    for c in a:
        at[c] = at.get(c, 0) | bit
        bit <<= 1
    mask = bit - 1
    up, down = mask, 0  # where the table rises and falls from one character of a to the next
    for c in b:
        eq = at.get(c, 0)
        same = (((eq & up) + up) ^ up | eq | down) & mask
        right = (down | mask ^ (same | up)) << 1 | 1
        down, up = right & same, ((same & up) << 1 | mask ^ (same | right) & mask) & mask
    return len(b) + up.bit_count() - down.bit_count()


def in_order(part: str, whole: str) -> bool:
    """Whether all characters of a text come in another one in the same order."""
    rest = iter(whole)
    return all(c in rest for c in part)


def _quick_errors(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Distances of pairs that are long or where one text is in the other; null for the others."""

    def quick(a: str | None, b: str | None) -> int | None:
        if a is None or b is None:
            return None
        if len(a) * len(b) >= BITS_FROM:
            return edit_distance(a, b)
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        return len(a) - len(b) if in_order(b, a) else None

    return pd.Series([quick(a, b) for a, b in zip(ref, hyp)], dtype="Int32")


def letter_errors(ref: Column, hyp: Column) -> Column:
    """Edit distance of two texts: F.levenshtein, whose time is the product of the lengths, where nothing is faster."""
    return F.coalesce(F.pandas_udf(_quick_errors, "int")(ref, hyp), F.levenshtein(ref, hyp))


def character(n: Column) -> Column:
    """The character of a number; null if there is none."""
    known, over = n.between(0, 0x10FFFF) & ~n.between(0xD800, 0xDFFF), n - 0x10000
    pair = F.concat(F.hex(F.shiftright(over, 10) + 0xD800), F.hex(over.bitwiseAND(0x3FF) + 0xDC00))
    units = F.when(n > 0xFFFF, pair).otherwise(F.lpad(F.hex(n), 4, "0"))
    return F.when(known, F.decode(F.unhex(units), "UTF-16BE"))  # UTF-32 would take U+FEFF for a mark of order


def time_token(seconds: Column, resolution: float = 0.02) -> Column:
    """<%.2f> of the time rounded half to even to the resolution."""
    return F.format_string("<%.2f>", F.rint(seconds / resolution) * resolution)


def repeats_character(text: Column, n: int = 11) -> Column:
    """Whether one character, whatever its case, comes n times or more in a row."""
    return F.regexp_like(text, F.lit(rf"(?i)(.)\1{{{n - 1},}}"))


def has_digit_run(text: Column, n: int = 15) -> Column:
    """Whether n digits stand together, as they are or without commas, bars, apostrophes and dots."""
    run = F.lit(rf"\d{{{n},}}")
    return F.regexp_like(text, run) | F.regexp_like(F.regexp_replace(text, r"[,|'.]", ""), run)


def repeats_word(text: Column, n: int = 5, longest: int = 3) -> Column:
    """Whether a word of at most `longest` characters comes more than n times in a row, whatever its case. Words stand
    between white space and , ; . ! ?"""
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[\s,;.!?]+", " ")), F.lit(" "))
    return F.regexp_like(flat, F.lit(rf"(?<= )([^ ]{{1,{longest}}}) (?:\1 ){{{n}}}"))


def one_character_over(text: Column, share: float = 0.5) -> Column:
    """Whether one character, whatever its case, is more than this share (at least a half) of a text without its white
    space; a blank text counts as one. Only the character in the middle of the sorted text can be."""
    flat = F.regexp_replace(F.lower(text), r"\s+", "")
    n = F.length(flat)
    middle = F.get(F.array_sort(F.split(flat, "")), F.floor(n / 2).cast("int"))
    return F.coalesce((n == 0) | (n - F.length(F.replace(flat, middle, F.lit(""))) > share * n), F.lit(True))


def not_fit(text: Column) -> Column:
    """Whether a text is blank or has too long a run of one character, one short word, one character in all, or
    digits."""
    return F.coalesce((F.trim(F.regexp_replace(text, r"\s+", " ")) == "") | repeats_character(text) | repeats_word(text) | one_character_over(text) | has_digit_run(text), F.lit(True))


def plain_spaces(text: Column) -> Column:
    """Unicode spaces and invisible marks as spaces."""
    return F.regexp_replace(text, "[\\u00a0\\u2000-\\u200f\\u2028-\\u202f]", " ")
