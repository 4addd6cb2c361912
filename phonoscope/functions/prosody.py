"""Syllables of a text in the ASCII notation.

A text is read into marks, sounds with their features; a left-to-right pass groups the marks by the longest
patterns of opening, vowel and closing consonants; closing patterns then give up what belongs to the next
syllable.  The pass depends on all that came before, so it runs in Python, on Arrow batches.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from phonoscope.functions import syllable_patterns as patterns
from phonoscope.functions.glyphs import VOWEL_LETTERS

# Features that follow a sound, and the sounds that each may follow.
MODIFIERS = {"h!": "voiceless", "h~": "aspirated", "w~": "labial", "y~": "palatal", "G~": "velar", "Q~": "pharyngeal"}
PUNCTUATION = "[.@?!+-]"
CLICKS, STOPS, TENSE, EJECTIVES, DENTALS = "ltdkp", "nqgdbptksfvzjxc", "nqgdbptksfvzjxc", "nqgdbptksfvzjxcCywQlr", "ntd"
SINGLES = "mnNqgGdbptTkKhHsSfFVvzZjJxXcCyWwQ'lLrR"
#: A vowel's tone, tried in this order.
TONES = r"--|-|\+\+|\+|/|//|\\/|/\\|\\\\|\\"
#: Features in the order in which they are written, with their marks; voiceless is not written.
WRITTEN = (
    ("click", "*"), ("ejective", "!"), ("implosive", "?"), ("nasal", "&"), ("tone", ""), ("long", "_"), ("short", "!"), ("stress", "^"),
    ("dental", "~"), ("pharyngeal", "Q~"), ("velar", "G~"), ("palatal", "y~"), ("labial", "w~"), ("aspirated", "h~"), ("stop", "."), ("tense", "@"),
)
# End of fixed values.

_CONSONANT_FEATURES = {"*": "click", ".": "stop", "@": "tense", "!": "ejective", "~": "dental"}
_ENDINGS = (("_", "^"), ("!", "^"), ("", "^"), ("_", ""), ("!", ""), ("", ""))
#: Keys are tried in order and the first that fits is taken, even where a later one is longer.
_MARK = re.compile(
    rf"=(?P<punctuation>{PUNCTUATION})|(?P<modifier>h!|[hwy]~|[GQ]~)"
    rf"|(?P<consonant>[{CLICKS}]\*|[{STOPS}]\.|[{TENSE}]@|[{EJECTIVES}]!|[{DENTALS}]~|[{SINGLES}])|(?P<space> )"
    + "".join(rf"|(?P<v{k}>[{VOWEL_LETTERS}]\$?)(?P<n{k}>&?)(?P<s{k}>@?)(?P<t{k}>(?:{TONES})?){re.escape(length + accent)}" for k, (length, accent) in enumerate(_ENDINGS))
)


@dataclass
class Mark:
    """A sound or punctuation with its features; the tone is kept as it is written."""

    value: str
    kind: str
    features: dict[str, str] = field(default_factory=dict)

    def __str__(self) -> str:
        return self.value + "".join((self.features[name] if name == "tone" else sign) for name, sign in WRITTEN if name in self.features)


def read_marks(text: str) -> list[Mark]:
    """The marks of a text; modifiers go to the mark before, or nowhere at the beginning."""
    marks: list[Mark] = []
    at = 0
    while at < len(text):
        m = _MARK.match(text, at)
        if not m:
            raise ValueError(f"Invalid characters found: {text[at:]}")
        at = m.end()
        if m["modifier"]:
            if marks:
                marks[-1].features[MODIFIERS[m["modifier"]]] = ""
        elif m["consonant"]:
            marks.append(Mark(m["consonant"][0], "consonant", {_CONSONANT_FEATURES[s]: "" for s in m["consonant"][1:]}))
        elif m["punctuation"] or m["space"]:
            marks.append(Mark(m["punctuation"] or " ", "punctuation"))
        else:
            k = next(k for k in range(len(_ENDINGS)) if m[f"v{k}"])
            length, accent = _ENDINGS[k]
            given = {"nasal": m[f"n{k}"], "tense": m[f"s{k}"], "tone": m[f"t{k}"], "long": length == "_", "short": length == "!", "stress": accent}
            marks.append(Mark(m[f"v{k}"], "vowel", {name: v if name == "tone" else "" for name, v in given.items() if v}))
    return marks


class Patterns:
    """Patterns in the order in which they are tried, those of one length at once; `ignored` and `span` are signs that take up no mark."""

    def __init__(self, ordered: list[str], ignored: str = "", span: str = ""):
        tables: dict[tuple[int, int], dict[str, str]] = defaultdict(dict)
        for pattern in ordered:
            text = pattern.replace(ignored, "", 1) if ignored else pattern
            count = len(text.replace(span, "")) if span else len(text)
            tables[len(pattern), count].setdefault(text, pattern)
        self.steps = [(count, table) for (_, count), table in tables.items()]

    def find(self, values: list[str], at: int) -> tuple[int, str] | None:
        """(marks, pattern) of the first pattern that the values spell from there on."""
        for count, table in self.steps:
            spelled = "".join(values[at : at + count])
            if spelled in table:
                return count, table[spelled]
        return None


WHOLE = Patterns(patterns.patterns(patterns.WHOLE))
OPENING = Patterns(patterns.patterns(patterns.OPENING, "OPENING"))
SINGLE = Patterns(patterns.SINGLE)
VOWELS = Patterns(patterns.patterns(patterns.VOWELS), span="$")
CLOSING = Patterns(patterns.patterns(patterns.CLOSING, "CLOSING"), ignored=":")


@dataclass
class Span:
    marks: list[Mark]
    pattern: str


def group_marks(marks: list[Mark]) -> list[str]:
    """Syllables of the marks, written out."""
    values = [m.value for m in marks]
    syllables: list[list[Span]] = []
    at = 0

    def take(found: tuple[int, str] | None, spans: list[Span]) -> bool:
        nonlocal at
        if found is None:
            return False
        spans.append(Span(marks[at : at + found[0]], found[1]))
        at += found[0]
        return True

    while at < len(marks):
        spans: list[Span] = []
        if marks[at].kind == "punctuation":
            take((1, marks[at].value), spans)
        elif not take(WHOLE.find(values, at), spans):
            take(OPENING.find(values, at), spans)
            if (single := SINGLE.find(values, at)) is not None:
                if spans:  # what opened stands alone, and the consonant opens anew
                    syllables.append(spans)
                    spans = []
                take(single, spans)
            take(VOWELS.find(values, at), spans)
            if not take(CLOSING.find(values, at), spans) and at == len(marks) - 1:
                take(SINGLE.find(values, at), spans)
            if not spans:
                raise ValueError(f"No match found for {''.join(values[at:])}")
        syllables.append(spans)
    _part(syllables)
    return _settled(["".join(str(m) for s in spans for m in s.marks) for spans in syllables])


def _part(syllables: list[list[Span]]) -> None:
    """Closing patterns with a colon keep what is before it; the rest goes to the front of the next syllable."""
    for before, after in zip(syllables, syllables[1:], strict=False):
        last = before[-1]
        head, colon, _ = last.pattern.partition(":")
        if not colon:
            continue
        spelled, cut = "", len(last.marks)
        for k, mark in enumerate(last.marks):
            spelled += mark.value
            if spelled == head:
                cut = k + 1
                break
        after[0].marks = last.marks[cut:] + after[0].marks
        last.marks = last.marks[:cut]


_HAS_VOWEL = re.compile(r"[ieaou]", re.I)
_AFFRICATE = re.compile(r"(?:tx|dj)$", re.I)
_CLUSTER = re.compile(r"[bcdfghjklmnpqrstvwxyz]([bcdfghjklmnpqrstvwxyz](?:[QGhy]~)?)$", re.I)


def _settled(texts: list[str]) -> list[str]:
    """Syllables without a vowel join the one before; a second closing consonant moves to a syllable that begins with a vowel."""
    out = texts[:1]
    for text in texts[1:]:
        if not _HAS_VOWEL.search(text):
            out[-1] += text
            continue
        if not _AFFRICATE.search(out[-1]) and _HAS_VOWEL.match(text) and (m := _CLUSTER.search(out[-1])):
            out[-1], text = out[-1][: -len(m[1])], m[1] + text
        out.append(text)
    return out


def syllabify(text: str) -> list[str]:
    """Syllables of one text; ValueError where a character or a sound fits nothing."""
    return group_marks(read_marks(text))


@lru_cache(maxsize=1 << 16)
def _syllabified(text: str) -> tuple[str, ...] | None:
    try:
        return tuple(syllabify(text))
    except ValueError:
        return None


def _syllables_of(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _syllabified(t) for t in texts], dtype=object)


def _strict_syllables_of(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else tuple(syllabify(t)) for t in texts], dtype=object)


def syllables(text: Column, on_error: str = "null") -> Column:
    """array of syllables; null for null, and for a text that can't be read unless on_error is "error"."""
    return F.pandas_udf(_strict_syllables_of if on_error == "error" else _syllables_of, "array<string>")(text)


MARK_TYPE = "array<struct<value: string, kind: string, tone: string, features: array<string>>>"


def _marks_of(texts: pd.Series) -> pd.Series:
    out = []
    for t in texts:
        try:
            read = None if t is None else read_marks(t)
        except ValueError:
            read = None
        out.append(None if read is None else [{"value": m.value, "kind": m.kind, "tone": m.features.get("tone"), "features": [f for f in m.features if f != "tone"]} for m in read])
    return pd.Series(out, dtype=object)


def marks(text: Column) -> Column:
    """array of struct(value, kind, tone, features): the sounds of a text; null where it can't be read."""
    return F.pandas_udf(_marks_of, MARK_TYPE)(text)


def written(marks: Column) -> Column:
    """The text of an array of marks as `marks` gives them, features in their fixed order."""

    def one(m: Column) -> Column:
        signs = [F.coalesce(m["tone"], F.lit("")) if name == "tone" else F.when(F.array_contains(m["features"], name), sign).otherwise("") for name, sign in WRITTEN]
        return F.concat(m["value"], *signs)

    return F.array_join(F.transform(marks, one), "")


def syllable_count(text: Column, on_error: str = "null") -> Column:
    """Number of syllables; null where there are none to tell."""
    parts = syllables(text, on_error)
    return F.when(parts.isNotNull(), F.size(parts))
