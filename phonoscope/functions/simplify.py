"""Simplified phonetic keys: rewrites of a text at several levels, each with a weight.

The 64 levels are all choices of vowels, consonants, tone, duration and aspiration.  A choice that keeps a feature always
multiplies the weight; one that reduces it does so only if it changed the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from phonoscope.functions.notation import machine

# Choices in order, and the weights they multiply by.
CHOICES = {
    "vowel": ("none", "one", "basic", "all"),
    "consonant": ("all", "simplified"),
    "tone": ("yes", "no"),
    "duration": ("yes", "no"),
    "aspiration": ("yes", "no"),
}
WEIGHTS = {
    "vowel": {"none": 2, "one": 5, "basic": 6, "all": 8},
    "consonant": {"all": 4, "simplified": 2},
    "tone": {"yes": 3, "no": 2},
    "duration": {"yes": 3, "no": 2},
    "aspiration": {"yes": 3, "no": 2},
}
KEPT = {"vowel": "all", "consonant": "all", "tone": "yes", "duration": "yes", "aspiration": "yes"}
#: Rewrites: plain text first, then patterns without regard to case.
CONSONANT_TEXTS = (("H", "h"), ("h~", "h"), ("y~", "y"), ("G~", ""), ("Q~", ""), ("w~", "w"), ("t~", "t"), ("d~", "d"))
CONSONANT_PATTERNS = (("b[?!@]?", "p"), ("p[?!*.@]?", "p"), ("t[?!*.@]?", "t"), ("d[?!*@]?", "t"), ("s[?!*@]?", "s"), ("j", "x"), ("v", "f"), ("z", "s"), ("d", "t"), ("g", "k"))
DIPHTHONGS = (("ai", "a"), ("au", "a"), ("ao", "o"), ("ae", "e"), ("io", "o"), ("ia", "a"), ("ou", "u"), ("oi", "i"))
#: Stands for the rhotic u$ while vowels are rewritten.
RHOTIC, HELD = "u$", "ð"
ESCAPED = r"=[^\n\r  ]"
# End of fixed values.

#: Choices are applied in this order, which is not the order in which levels are numbered.
ORDER = ("consonant", "vowel", "tone", "aspiration", "duration")
_MARKS = r"[\^&_+\-!@]*"


def _text(column: Column, old: str, new: str) -> Column:
    return F.replace(column, F.lit(old), F.lit(new))


def _simple_consonants(t: Column) -> Column:
    for old, new in CONSONANT_TEXTS:
        t = _text(t, old, new)
    for pattern, new in CONSONANT_PATTERNS:
        t = F.regexp_replace(t, f"(?i){pattern}", new)
    return t


def _no_vowels(t: Column) -> Column:
    return _text(F.regexp_replace(_text(t, RHOTIC, HELD), r"(?i)[aeiou][$^&_+\-!@]*", ""), HELD, RHOTIC)


def _one_vowel(t: Column) -> Column:
    t = F.regexp_replace(_text(t, RHOTIC, HELD), r"(?i)([aeiou])\$", "$1")
    return F.regexp_replace(_text(F.regexp_replace(t, rf"(?i)[aeiou]{_MARKS}", "a"), HELD, RHOTIC), "a+", "a")


def _basic_vowels(t: Column) -> Column:
    t = F.regexp_replace(_text(t, RHOTIC, HELD), r"(?i)([aeiou])\$", "$1")
    t = F.translate(F.regexp_replace(t, rf"(?i)([aeiou]){_MARKS}", "$1"), "AEIOU", "aeiou")
    for vowel in "aeiou":
        t = F.regexp_replace(t, f"{vowel}+", vowel)
    for pair, new in DIPHTHONGS:
        t = _text(t, pair, new)
    return _text(t, HELD, RHOTIC)


REWRITES: dict[tuple[str, str], Callable[[Column], Column]] = {
    ("consonant", "simplified"): _simple_consonants,
    ("vowel", "none"): _no_vowels,
    ("vowel", "one"): _one_vowel,
    ("vowel", "basic"): _basic_vowels,
    ("tone", "no"): lambda t: F.regexp_replace(t, "[-+]+", ""),
    ("aspiration", "no"): lambda t: _text(t, "h~", ""),
    ("duration", "no"): lambda t: _text(t, "_", ""),
}


def without_escapes(text: Column) -> Column:
    """The text without escaped characters, as simplification begins."""
    return F.regexp_replace(text, ESCAPED, "")


def weighted(text: Column, raw: Column, feature: str, choice: str) -> tuple[Column, Column]:
    """The text under one choice, and the weight multiplied by the choice's own."""
    weight = F.lit(WEIGHTS[feature][choice])
    if choice == KEPT[feature]:
        return text, raw * weight
    new = REWRITES[feature, choice](text)
    return new, raw * F.when(new != text, weight).otherwise(1)


def simplify_case(text: Column, vowel: str = "all", consonant: str = "all", tone: str = "yes", duration: str = "yes", aspiration: str = "yes") -> Column:
    """struct(text, code, raw): one level of simplification."""
    level = {"vowel": vowel, "consonant": consonant, "tone": tone, "duration": duration, "aspiration": aspiration}
    for feature, choice in level.items():
        if choice not in CHOICES[feature]:
            raise ValueError(f"{feature} has no choice {choice!r}")
    now, raw = text, F.lit(1).cast("long")
    for feature in ORDER:
        now, raw = weighted(now, raw, feature, level[feature])
    return F.struct(now.alias("text"), machine(now).alias("code"), raw.alias("raw"))


def step_size(feature: str) -> int:
    """How far apart the numbers of a feature's choices are when levels are numbered in the order of CHOICES."""
    size = 1
    for name in reversed(CHOICES):
        if name == feature:
            return size
        size *= len(CHOICES[name])
    raise KeyError(feature)


def variants(text: Column, raw: Column, ordinal: Column, feature: str) -> Column:
    """array of struct(text, raw, ordinal): all choices of one feature."""
    out = []
    for k, choice in enumerate(CHOICES[feature]):
        new, weight = weighted(text, raw, feature, choice)
        out.append(F.struct(new.alias("text"), weight.alias("raw"), (ordinal + k * step_size(feature)).alias("ordinal")))
    return F.array(*out)


def _step(feature: str) -> Callable[[Column], Column]:
    return lambda v: variants(v["text"], v["raw"], v["ordinal"], feature)


def choice_of(ordinal: Column, feature: str) -> Column:
    """The name of a feature's choice at a numbered level."""
    names = F.array(*[F.lit(c) for c in CHOICES[feature]])
    return F.element_at(names, (F.floor(ordinal / step_size(feature)) % len(CHOICES[feature]) + 1).cast("int"))


def load(ordinal: Column) -> Column:
    """map of feature to choice at a numbered level."""
    return F.create_map(*[x for f in CHOICES for x in (F.lit(f), choice_of(ordinal, f))])


def normalized_mass(raw: Column, least: Column, most: Column) -> Column:
    """(raw - (least - 1)) / (most - (least - 1)) to four decimals, rounded half up in whole numbers."""
    span = most - least + 1
    return F.floor((F.lit(20000) * (raw - least + 1) + span) / (2 * span)) / F.lit(10000.0)


def simplify(text: Column) -> Column:
    """array of struct(text, code, mass, load), heaviest first: all levels, each text once with its greatest weight.

    No shuffle: every row is worked out alone, so this form also serves streams.
    """
    start = F.struct(without_escapes(text).alias("text"), F.lit(1).cast("long").alias("raw"), F.lit(0).alias("ordinal"))
    views = F.array(start)
    for feature in ORDER:
        views = F.flatten(F.transform(views, _step(feature)))
    # Sorted by text, weight (greatest first) and number, the first of each text wins; its first number orders ties.
    keyed = F.transform(views, lambda v: F.struct(v["text"].alias("text"), (-v["raw"]).alias("light"), v["ordinal"].alias("ordinal")))

    def merged(acc: Column, v: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fresh = (F.size(acc) == 0) | (last["text"] != v["text"])
        entry = F.struct(v["text"].alias("text"), v["light"].alias("light"), v["ordinal"].alias("ordinal"), v["ordinal"].alias("seen"))
        better = F.struct(last["text"].alias("text"), last["light"].alias("light"), last["ordinal"].alias("ordinal"), F.least(last["seen"], v["ordinal"]).alias("seen"))
        return F.when(fresh, F.concat(acc, F.array(entry))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(better)))

    empty = F.array().cast("array<struct<text:string,light:bigint,ordinal:int,seen:int>>")
    best = F.filter(F.aggregate(F.array_sort(keyed), empty, merged), lambda v: v["text"] != "")

    def ranked(found: Column) -> Column:
        lights = F.transform(found, lambda v: v["light"])
        ends = F.struct((-F.array_max(lights)).alias("least"), (-F.array_min(lights)).alias("most"))
        order = F.array_sort(F.transform(found, lambda v: F.struct(v["light"].alias("light"), v["seen"].alias("seen"), v["text"].alias("text"), v["ordinal"].alias("ordinal"))))
        view = lambda v, e: F.struct(v["text"].alias("text"), machine(v["text"]).alias("code"), normalized_mass(-v["light"], e["least"], e["most"]).alias("mass"), load(v["ordinal"]).alias("load"))
        return _with(ends, lambda e: F.transform(order, lambda v: view(v, e)))

    return F.when(text.isNotNull(), _with(best, ranked))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)
