"""Text functions on columns; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space and the four ASCII separators.
SPACES = r"(?U)[\s\x1c-\x1f]+"
#: Word boundaries that do not depend on the JVM's idea of \b.
ENTITY = r"(?<![\p{L}\p{N}_])[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}(?![\p{L}\p{N}_])"
MODES = ("none", "lower", "simple")
#: ASCII letters, lower-cased, and digits; all other bytes to spaces.
TO_TOKENS = bytes(b if b < 0x80 and chr(b).isalnum() else 0x20 for b in range(256)).lower()


def normalize_whitespace(text: Column) -> Column:
    """White space made single, ends trimmed."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def tokenize(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased after they are cut out."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), 0), lambda t: F.lower(t))


def normalize_entity(text: Column, mode: str = "none") -> Column:
    """``none``: as it is; ``lower``: trimmed, lower case; ``simple``: also other characters to spaces, single."""
    if mode not in MODES:
        raise ValueError(f"unknown entity mode: {mode}")
    if mode == "none":
        return text
    low = F.lower(F.trim(text))
    if mode == "lower":
        return low
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9\s]+", " "), r"\s+", " "))


def extract_entities(text: Column, dedup: bool = True) -> Column:
    """Runs of one to four capitalised words, in order; each once, if asked."""
    found = F.regexp_extract_all(text, F.lit(ENTITY), 0)
    return F.array_distinct(found) if dedup else found


def join_sentences(sentences: Column) -> Column:
    return normalize_whitespace(F.array_join(sentences, " "))


def title_aliases(title: Column) -> Column:
    """The title, and the title without a closing bracket where that differs and is not empty."""
    bare = F.trim(F.regexp_replace(title, r"\s*\([^)]*\)\s*$", ""))
    return F.when((bare != "") & (bare != title), F.array(title, bare)).otherwise(F.array(title))


def normalize_answer(text: Column, compat: bool = False) -> Column:
    """Lower case, other characters to spaces, spaces made single (not in ``compat``), trimmed.

    ``compat`` keeps backslashes and the letter s apart from white space the way
    that published scores were made: every other character becomes one space.
    """
    low = F.lower(text)
    if compat:
        return F.trim(F.regexp_replace(low, r"[^0-9a-z\\]", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^0-9a-z]+", " "), " +", " "))


def short_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def tex_escape(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit("\\_"))
