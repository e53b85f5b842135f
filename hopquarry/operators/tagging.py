"""Entities by a tagger: any model of spans with labels, with the pattern where it cannot be loaded."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import extract_entities, normalize_entity

#: Labels of entities that count.
LABELS = ("PERSON", "ORG", "GPE", "LOC", "FAC", "NORP", "EVENT", "PRODUCT", "WORK_OF_ART", "LAW")

#: Spans of each text of a batch: their texts and labels.
Tagger = Callable[[list[str]], list[list[tuple[str, str]]]]


def tagged_spans(text: Column, load: Callable[[], Tagger]) -> Column:
    """``array<struct<span, label>>``; null where the tagger cannot be loaded or fails on a batch.

    ``load`` runs once in each Python task; the tagger gets batches of texts.
    """

    @F.pandas_udf("array<struct<span: string, label: string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            tagger = load()
        except Exception:  # the model is not there: the pattern takes its place
            tagger = None
        for batch in batches:
            found = None
            if tagger is not None:
                try:
                    found = [[{"span": s, "label": label} for s, label in spans] for spans in tagger(batch.fillna("").tolist())]
                except Exception:  # likewise for a batch that it fails on
                    found = None
            yield pd.Series(found if found is not None else [None] * len(batch), dtype=object)

    return run(text)


def tagged_entities(text: Column, load: Callable[[], Tagger], mode: str = "none", dedup: bool = True, labels: tuple[str, ...] = LABELS) -> Column:
    """Spans with one of the labels: stripped, normalised, and only then each once.

    Without the tagger: the pattern's entities, each once before they are normalised.
    """
    kept = F.filter(tagged_spans(text, load), lambda s: s["label"].isin(*labels))
    names = F.transform(kept, lambda s: normalize_entity(F.regexp_replace(s["span"], r"(?U)^\s+|\s+$", ""), mode))
    names = F.filter(names, lambda n: n != "")
    plain = F.transform(extract_entities(text, dedup), lambda n: normalize_entity(n, mode))
    return F.coalesce(F.array_distinct(names) if dedup else names, plain)


def gazetteer(names: dict[str, str]) -> Callable[[], Tagger]:
    """A tagger for known names (name to label): one pass of an automaton, the longest name from the left, between word ends.

    The names go to every task, so they are for dictionaries that fit a worker.
    """

    def load() -> Tagger:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in names:
            if name:
                automaton.add_word(name, name)
        automaton.make_automaton()
        word = lambda c: c.isalnum() or c == "_"

        def spans(text: str) -> list[tuple[str, str]]:
            # all names between word ends; of those that overlap, the first and longest
            found = sorted(
                (end + 1 - len(name), -len(name), name)
                for end, name in (automaton.iter(text) if len(automaton) else ())
                if not (end + 1 < len(text) and word(name[-1]) and word(text[end + 1])) and not (end >= len(name) and word(name[0]) and word(text[end - len(name)]))
            )
            out, free = [], 0
            for start, size, name in found:
                if start >= free:
                    out.append((name, names[name]))
                    free = start - size
            return out

        return lambda texts: [spans(text) for text in texts]

    return load


def pattern_tagger() -> Tagger:
    """A stand-in model: capitalised runs, labelled by their length (every fifth length has a label that does not count)."""
    import re

    pattern = re.compile(r"(?<!\w)[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}(?!\w)")
    return lambda texts: [[(f" {m[0]}\n", "DATE" if len(m[0]) % 5 == 0 else "PERSON") for m in pattern.finditer(text)] for text in texts]
