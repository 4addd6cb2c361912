"""Benchmark decontamination by the q-gram lemma.

An occurrence of an item of m characters within k edits shares at least m - q + 1 - kq of its q-grams with the
item, and all of them lie within k + 1 neighbouring diagonals (position in the text less position in the item).  For each text the
q-grams that the items hold are looked up all at once, counted in overlapping diagonal bands, and only bands
that reach the bound are verified by a banded alignment.  Texts are never compared with items one by one, and
the item set is handled in blocks of bounded size, each against all rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoscope.llm.common import row_of, text_of, vectorized

#: Length of a q-gram, edits allowed for each character of an item, and the length under which items are only looked for as they are.
Q, EDITS, SHORTEST = 10, 0.08, 24
#: Characters of items in one block, characters of texts whose q-grams are looked up at once, and shared q-grams that are counted at once.
BLOCK, SLICE, SHARED = 4 << 20, 1 << 19, 1 << 21
TOKEN = re.compile(r"\w+|[^\w\s]")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
_BREAK = 0x7FFFFFFF


def normalized(text: str) -> str:
    """Lower case, with runs of white space as one space."""
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit code for the q-gram that starts at each place; codes shorter than q give none."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, scale, step, have = None, np.uint64(1), codes.astype(np.uint64) + np.uint64(1), 1
    with np.errstate(over="ignore"):
        base, left, at = _BASE, Q, 0
        power = base
        while left:  # Q as a sum of powers of two, with the codes of that many characters each
            if left & 1:
                part = step[at : at + n] * scale
                out = part if out is None else out + part
                scale, at = scale * power, at + have
            left >>= 1
            if left:
                step = step[:-have] + step[have:] * power
                power, have = power * power, have * 2
        out = out * _BASE
        return (out ^ (out >> np.uint64(29))) * _BASE


class Items:
    """Benchmark items with their q-grams indexed."""

    def __init__(self, items: list[tuple[int, str]]):
        named = [(i, normalized(t)) for i, t in items]
        kept = [(i, t) for i, t in named if len(t) >= SHORTEST]
        self.short: dict[str, list[tuple[int, str]]] = defaultdict(list)
        for i, t in named:
            if 0 < len(t) < SHORTEST:
                self.short[TOKEN.search(t)[0]].append((i, t))
        self.ids = [i for i, _ in kept]
        self.texts = [t for _, t in kept]
        self.codes = [_codes(t) for t in self.texts]
        self.length = np.array([len(c) for c in self.codes], dtype=np.int64)
        edits = [min(int(EDITS * n), (n - Q) // Q) for n in self.length]  # at least one shared q-gram must be left
        self.edits = np.array(edits, dtype=np.int64)
        self.least = self.length - Q + 1 - self.edits * Q
        grams = [_grams(c) for c in self.codes]
        flat = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, dtype=np.int64)
        order = np.argsort(flat, kind="stable")
        self.gram, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.owner, self.place = owner[order], place[order]
        self.filter = np.zeros(1 << _BITS, dtype=bool)
        self.filter[(self.gram >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def bands(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first, last): start places of occurrences in codes whose diagonal band holds as many shared q-grams as the bound asks."""
        found: list[tuple[int, int, int]] = []
        if not len(self.gram):
            return found
        grams = _grams(codes)
        at = np.flatnonzero(self.filter[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
        spot = np.searchsorted(self.gram, grams[at])
        spot[spot == len(self.gram)] = 0
        real = self.gram[spot] == grams[at]
        at, spot = at[real], spot[real]
        many = self.first[spot + 1] - self.first[spot]
        if not len(many):
            return found
        stride = len(codes) + int(self.length.max()) * 2 + 2
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        upto = np.cumsum(many)
        begin = 0
        while begin < len(many):  # text and item may both repeat a q-gram very often, so pairs are counted by slices
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + SHARED, "right")))
            more, times = self._bands_of(at[begin:end], spot[begin:end], many[begin:end], stride)
            keys, place = np.unique(np.concatenate([keys, more]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, times])).astype(np.int64)
            begin = end
        after = np.searchsorted(keys, keys + 1)
        after[after == len(keys)] = 0
        both = counts + np.where(keys[after] == keys + 1, counts[after], 0)
        # A band that begins just before the first filled one holds no more than that one and its neighbour.
        for key in keys[both >= self.least[keys // stride]]:
            item, b = int(key // stride), int(key % stride)
            w, m, k = int(self.edits[item]) + 1, int(self.length[item]), int(self.edits[item])
            found.append((item, b * w - m - k, (b + 2) * w - m + k))
        return found

    def _bands_of(self, at: np.ndarray, spot: np.ndarray, many: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
        """Bands (item * stride + band) of these shared q-grams, and how many lie in each."""
        pair = np.repeat(self.first[spot] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(int(many.sum()))
        owner = self.owner[pair]
        band = (np.repeat(at, many) - self.place[pair] + self.length[owner]) // (self.edits[owner] + 1)
        keys = owner * stride + band
        low = int(keys.min())
        if int(keys.max()) - low < 4 * SHARED:
            counts = np.bincount(keys - low)
            held = np.flatnonzero(counts)
            return held + low, counts[held]
        return np.unique(keys, return_counts=True)

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item id, start, end, edits) of its occurrences, the best of each item, in the normalised text."""
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        short: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        overlap = int(self.length.max() + 4 * self.edits.max() + 4) if len(self.length) else 0
        group: list[tuple[int, int, np.ndarray]] = []
        size = 0
        for n, raw in enumerate(texts):
            text = normalized(raw)
            short[n] = self._short(text)
            codes = _codes(text)
            for begin in range(0, max(1, len(codes) - overlap), SLICE):  # pieces of a long text overlap by an occurrence and its band
                group.append((n, begin, codes[begin : begin + SLICE + overlap]))
                size += len(group[-1][2])
                if size >= SLICE:
                    self._search(group, best)
                    group, size = [], 0
        self._search(group, best)
        return [sorted([(self.ids[item], *hit) for item, hit in hits.items()] + more) for hits, more in zip(best, short, strict=True)]

    def _short(self, text: str) -> list[tuple[int, int, int, int]]:
        """The first occurrence, as they are, of items too short for edits, between characters that are not of a word."""
        found: dict[tuple[int, str], int] = {}
        for m in TOKEN.finditer(text) if self.short else ():
            for item in self.short.get(m[0], ()):
                at = m.start()
                if item not in found and text.startswith(item[1], at) and not (text[at + len(item[1]) : at + len(item[1]) + 1].isalnum() and item[1][-1].isalnum()):
                    found[item] = at
        return [(i, at, at + len(t), 0) for (i, t), at in found.items()]

    def _search(self, group: list[tuple[int, int, np.ndarray]], best: list[dict[int, tuple[int, int, int]]]) -> None:
        if not group:
            return
        stop = np.array([_BREAK], dtype=np.uint32)
        joined = np.concatenate([x for _, _, c in group for x in (c, stop)])
        starts = np.cumsum([0] + [len(c) + 1 for _, _, c in group])
        for item, low, high in self.bands(joined):
            m, k = int(self.length[item]), int(self.edits[item])
            # The band may reach over a break: look into each text it touches.
            first = max(0, int(np.searchsorted(starts, max(low, 0), "right")) - 1)
            last = min(len(group) - 1, int(np.searchsorted(starts, max(high + m, 0), "right")) - 1)
            for g in range(first, last + 1):
                a, b = max(low, int(starts[g])), min(high + m + k, int(starts[g + 1]) - 1)
                hits, shift = best[group[g][0]], group[g][1] - int(starts[g])
                if b - a < m - k or item in hits and hits[item][2] == 0:
                    continue
                hit = _exact(self.codes[item], joined[a:b]) or align(self.codes[item], joined[a:b], k)
                if hit and (item not in hits or hit[2] < hits[item][2]):
                    hits[item] = (a + shift + hit[0], a + shift + hit[1], hit[2])


def _exact(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int] | None:
    at = region.tobytes().find(item.tobytes())
    return (at // 4, at // 4 + len(item), 0) if at >= 0 and at % 4 == 0 else None


def align(item: np.ndarray, region: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best occurrence of item in region within k edits, or none.

    Rows run over the region's start places, so the band of diagonals is as wide as the region exceeds the item, and k more on each side.
    """
    m, n = len(item), len(region)
    width = n - m + 2 * k + 1
    if width <= 0:
        return None
    shift = np.arange(width) - k  # place in the region of column c in row i is i + shift[c]
    far = m + n + 1
    cost = np.where((shift >= 0) & (shift <= n), 0, far)
    began = shift.copy()
    steps = np.arange(width)
    padded = np.concatenate([np.full(k + 1, _BREAK, dtype=np.uint32), region, np.full(m + k + 2, _BREAK, dtype=np.uint32)])
    for i in range(m):
        match = padded[i + 1 : i + 1 + width] == item[i]
        match &= padded[i + 1 : i + 1 + width] != _BREAK
        same = cost + np.where(match, 0, 1)
        same[(i + shift < 0) | (i + shift >= n)] = far
        drop = np.append(cost[1:], far) + 1
        down = np.append(began[1:], 0)
        use = same <= drop
        step = np.where(use, same, drop)
        origin = np.where(use, began, down)
        step[(i + 1 + shift < 0) | (i + 1 + shift > n)] = far
        level = step - steps
        least = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == least, steps, 0))
        cost, began = least + steps, origin[source]
        if cost.min() > k:
            return None
    c = int(cost.argmin())
    return (int(began[c]), m + int(shift[c]), int(cost[c])) if cost[c] <= k else None


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most about BLOCK characters, whatever the size of the table."""
    items, size = [], 0
    named = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text")).where("id is not null")
    for i, t in named.distinct().sort("id", "text").toLocalIterator():
        items.append((i, t))
        size += len(t)
        if size >= BLOCK:
            yield items
            items, size = [], 0
    if items:
        yield items


@lru_cache(maxsize=1)
def _indexed(items: tuple[tuple[int, str], ...]) -> Items:
    return Items(list(items))


def _finder(items: list[tuple[int, str]]):
    fixed = tuple(items)

    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"item_id": i, "start": a, "end": b, "edits": e} for i, a, b, e in hits] for hits in _indexed(fixed).search(list(texts))])

    return vectorized(find, "array<struct<item_id: bigint, start: int, end: int, edits: int>>")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each input row and item that occurs in it: id, item_id, start, end, edits (in the normalised text).

    Null and empty texts and items have no occurrence.  Items shorter than SHORTEST occur only as they are, as
    whole words.  Repeated rows give repeated results, and an item id with several texts is looked for by each.
    """
    kept = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    found = [kept.select("id", F.explode(_finder(items)("text")).alias("hit")).select("id", "hit.*") for items in blocks(benchmark, item_col, item_text)]
    if not found:
        return kept.limit(0).select("id", *[F.lit(0).cast(t).alias(c) for c, t in (("item_id", "long"), ("start", "int"), ("end", "int"), ("edits", "int"))])
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without those that hold an item; columns unchanged."""
    rows = docs.select(row_of(docs).alias("row"), text_of(text_col).alias("text"))
    for items in blocks(benchmark, item_col, item_text):
        rows = rows.where(F.size(_finder(items)("text")) == 0)
    return rows.select("row.*")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("id", "doc_id")
