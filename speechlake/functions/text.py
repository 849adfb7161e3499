"""Text functions as Catalyst expressions: normalizers, tokens, token categories, utterance classes."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = string.punctuation
#: White space, with the four separators of ASCII that Unicode doesn't call so.
_GAP = r"[\s\x1c-\x1f]"


def normalize_basic(x: Column) -> Column:
    """Lower case without the 32 ASCII punctuation characters; white space stays."""
    return F.translate(F.lower(x), PUNCTUATION, "")


def normalize_advanced(x: Column, lower: bool = True, punctuation: bool = True, collapse: bool = True, strip: bool = True) -> Column:
    """Null to empty, yo to ye, and as asked: lower case, Unicode punctuation removed, runs of white space to one space, ends trimmed."""
    x = F.translate(F.coalesce(x, F.lit("")), "ёЁ", "еЕ")
    x = F.lower(x) if lower else x
    x = F.regexp_replace(x, r"\p{P}", "") if punctuation else x
    x = F.regexp_replace(x, f"(?U){_GAP}{_GAP}+", " ") if collapse else x
    return F.regexp_replace(x, f"(?U)^{_GAP}+|{_GAP}+$", "") if strip else x


def tokens(x: Column) -> Column:
    """Words between runs of white space, none of them empty."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), f"(?U){_GAP}+"), lambda t: t != "")


def is_number(t: Column) -> Column:
    return t.rlike(r"^[+-]?\d+[\d\s,.]*$")


def is_abbreviation(t: Column) -> Column:
    """Letters, with an optional dot behind, all upper case."""
    return t.rlike(r"^\p{L}+\.?$") & (t == F.upper(t)) & (t != F.lower(t))


def token_category(t: Column) -> Column:
    t = F.coalesce(t, F.lit(""))
    return F.when(t == "", "word").when(is_number(t), "number").when(is_abbreviation(t), "abbr").when(t.rlike("[A-Za-z]"), "latin").otherwise("word")


def classify_utterance(wer: Column, sim: Column, high: float = 0.4, middle: float = 0.15, near: float = 0.6) -> Column:
    """How badly an utterance is misunderstood, from its error rate and, where known, its similarity."""
    return F.when((wer >= high) & (sim.isNull() | (sim <= near)), "full_misunderstanding").when(wer >= middle, "partial").otherwise("local")


def capitalized_tokens(x: Column) -> Column:
    """Tokens that begin upper case and aren't all upper case: a stand-in for names."""
    first = lambda t: F.substring(t, 1, 1)
    return F.filter(tokens(x), lambda t: (first(t) != F.lower(first(t))) & (first(t) == F.upper(first(t))) & ((t != F.upper(t)) | (t == F.lower(t))))


def flatten_confusions(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["ref"], F.lit("->"), p["hyp"])), ";")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_suffix(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
