"""Toxicity: a Levenshtein automaton intersected with a lexicon trie, and context windows around its hits.

The lexicon is learned from labelled rows: whole words and word stems that toxic texts hold far more often than
clean ones.  Its trie and the automata of all its terms run as one machine, determinised as it meets letters,
so a word is read once whatever the size of the lexicon.  Each (term, edits) has the log odds that a text with such a hit
is toxic; a hit in a quotation, judged from a window around it, counts for less.  A logistic regression turns
the strongest hit, their sum and their density into the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Container, Iterable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoscope.llm.common import bucket_of, materialize, row_of, small, text_of, vectorized

#: About so many labelled rows of each class are drawn, by a hash of their id, to fit the classifier.
SAMPLE = 3000
#: Shortest and longest stem (whole words may have any length); a term needs so many toxic texts; terms of no effect that may be chosen.
STEM, LONGEST, SUPPORT, FALSE = 4, 10, 3, 0.2
#: Jaccard similarity of their words from which two texts of a class count once.
LIKE = 0.7
#: Edits allowed in a whole word or a stem of at least so many letters.
EDITS, STEM_EDITS = ((9, 2), (5, 1)), ((7, 1),)
#: Characters on each side of a hit that are searched for quotation marks and reporting words, and what a quoted hit keeps.
WINDOW, QUOTED = 60, 0.4
REPORTS = re.compile(r"\b(?:said|says|called|calls|quoted?|wrote|word|words|term|phrase|sagte|nannte|wort|dijo|llamó|palabra|dit|appelé|mot)\b")
TOKEN = re.compile(r"[^\W_]+")
_RUN = re.compile(r"(.)\1{2,}")
#: Words whose reading is remembered in each Python worker, the most characters of one, and states of the machine that are kept.
REMEMBERED, LONG, STATES = 1 << 16, 64, 1 << 15


def edits_for(term: str) -> int:
    """Edits a term allows; whole words end in $."""
    whole = term.endswith("$")
    return next((k for n, k in (EDITS if whole else STEM_EDITS) if len(term) - whole >= n), 0)


class Machine:
    """The terms' Levenshtein automata intersected with their trie, as one lazily determinised automaton."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most: list[int] = [0]
        for number, term in enumerate(terms):
            node, k = 0, edits_for(term)
            self.most[0] = max(self.most[0], k)
            for c in term.removesuffix("$"):
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.child[node][c]
                self.most[node] = max(self.most[node], k)
            self.ends[node].append(number)
        self.seen: dict[str, tuple] = {}
        self._begin()

    def _begin(self) -> None:
        """Forget the states made so far, so that rare words cannot fill the memory."""
        self.ids: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.stems: list[tuple] = []
        self.wholes: list[tuple] = []
        self.dead = self._state({})
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """The state for trie nodes with their least edits, letters missing from the word included."""
        todo, full = sorted(reached.items()), {}
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or full.get(node, 99) <= e:
                continue
            full[node] = e
            todo += [(n, e + 1) for n in self.child[node].values()]
        key = frozenset(full.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(full)
            self.moves.append({})
            hits = [(t, e) for node, e in full.items() for t in self.ends[node] if e <= edits_for(self.terms[t])]
            self.stems.append(tuple(h for h in hits if not self.terms[h[0]].endswith("$")))
            self.wholes.append(tuple(h for h in hits if self.terms[h[0]].endswith("$")))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}
        for node, e in self.sets[state].items():
            for to, cost in [(node, e + 1), *((n, e + (x != c)) for x, n in self.child[node].items())]:
                if cost < reached.get(to, 99):
                    reached[to] = cost
        self.moves[state][c] = out = self._state(reached)
        return out

    def read(self, word: str) -> tuple:
        """(term, edits) of the terms that the word is, or begins with, fewest edits first."""
        hits = self.seen.get(word)
        if hits is None:
            if len(self.sets) > STATES:
                self._begin()
            best: dict[int, int] = {}
            state, moves = self.start, self.moves
            for c in _RUN.sub(r"\1", word):
                to = moves[state].get(c)
                state = self._step(state, c) if to is None else to
                if state == self.dead:
                    break
                for t, e in self.stems[state]:
                    best[t] = min(e, best.get(t, 99))
            for t, e in self.wholes[state]:
                best[t] = min(e, best.get(t, 99))
            hits = tuple(sorted(best.items(), key=lambda h: (h[1], h[0])))
            if len(word) <= LONG:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[word] = hits
        return hits


def is_quoted(text: str, start: int, end: int) -> bool:
    """Whether the window around a hit marks it as quoted: a mark on each side, or a reporting word and one mark."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    left = before.count('"') % 2 == 1 or before.rfind("“") > before.rfind("”") or before.rfind("«") > before.rfind("»")
    right = '"' in after or "”" in after or "»" in after
    return left and (right or bool(REPORTS.search(before)))


def hits_of(text: str, machine: Machine) -> tuple[list[tuple[int, int, bool]], int]:
    """(term, edits, quoted) of every hit in the whole text, and its number of words."""
    text = text.lower()
    words = TOKEN.findall(text)
    read = machine.read
    if not any(map(read, set(words))):
        return [], len(words)
    found = []
    for m in TOKEN.finditer(text):
        if hits := read(m[0]):
            found.append((*hits[0], is_quoted(text, m.start(), m.end())))
    return found, len(words)


def _drawn(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic and text of a bounded sample of the labelled rows that are not held out."""
    labelled = labels.where(bucket_of("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("doc_id is not null and toxic is not null")
    labelled = materialize(labelled.select("doc_id", (F.col("toxic") > 0).alias("toxic")))
    n = {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    limit = F.when(F.col("toxic"), SAMPLE / max(n.get(True, 0), 1)).otherwise(SAMPLE / max(n.get(False, 0), 1))
    ids = labelled.where(u < limit)  # about 2 * SAMPLE rows, whatever the size of the tables
    texts = docs.select("doc_id", text_of("text").alias("text"))
    rows = materialize(texts.join(small(materialize(ids), 16), "doc_id").select("toxic", "text").distinct())
    # Where ids repeat, rows are more than ids: they are drawn again, by their texts.
    share = 3 * SAMPLE / max(rows.count(), 1)
    return rows if share >= 1 else materialize(rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20))))


def unlike(rows: Iterable[tuple[bool, str]]) -> Iterator[tuple[bool, set[str]]]:
    """(toxic, words) of the texts, in an order of their own, without those whose words are much as those of one before in their class.

    Texts that share one of two minima over their words under different hashes, as near copies nearly always do, are
    compared, and the later is left out if the Jaccard similarity of their words is LIKE or more.
    """
    families: dict[tuple, list[np.ndarray]] = defaultdict(list)
    for toxic, text in sorted(rows):
        words = set(TOKEN.findall(text.lower()))
        if not words:
            continue
        codes = np.unique(np.fromiter((crc32(w.encode()) for w in words), dtype=np.uint64, count=len(words)))
        family = [families[toxic, 0, int(codes[0])], families[toxic, 1, int((codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(7)).min())]]
        if any(_like(codes, other) for others in family for other in others):
            continue
        for others in family:
            others.append(codes)
        yield toxic, words


def _like(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < LIKE * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= LIKE * (len(a) + len(b) - shared)


def _counts(rows: list[tuple[bool, str]], only: Container[str] | None = None) -> tuple[int, Counter]:
    """The number of texts that are unlike, and how many of them hold each whole word and stem (of `only`, if given)."""
    size, held = 0, Counter()
    for _, words in unlike(rows):
        size += 1
        terms = {w[:k] for w in words for k in range(STEM, min(len(w), LONGEST) + 1)} | {w + "$" for w in words}
        held.update(terms if only is None else [t for t in terms if t in only])
    return size, held


def learn_lexicon(rows: Iterable[tuple[bool, str]]) -> list[str]:
    """Whole words (ending in $) and stems that toxic texts hold far more often than clean ones do.

    A term is chosen if its likelihood ratio statistic is significant among all that are tried, and of nested ones
    the one with the greatest; near copies of a text count once.
    """
    of_class: dict[bool, list[tuple[bool, str]]] = {True: [], False: []}
    for row in rows:
        of_class[bool(row[0])].append(row)
    n, bad = _counts(of_class.pop(True))
    for t in [t for t, k in bad.items() if k < SUPPORT]:
        del bad[t]
    m, good = _counts(of_class.pop(False), bad)  # other terms are not tried, so their counts need no room

    def ratio(t: str) -> float:
        a, b = bad[t], good[t]
        if a * m <= b * n:
            return 0.0
        p, total = (a + b) / (n + m), 0.0
        for k, of in ((a, n), (b, m)):
            total += (k * math.log(k / (of * p)) if k else 0.0) + ((of - k) * math.log((of - k) / (of * (1 - p))) if of > k else 0.0)
        return 2 * total

    tried = sorted(((ratio(t), len(t), t) for t in bad), reverse=True) if n and m else []
    chosen: list[str] = []
    least = 2 * math.log(max(len(tried), 1) / FALSE)  # a statistic that so many terms of no effect reach about FALSE times in all
    for g, _, t in tried:
        if g < least:
            break
        stem = t.removesuffix("$")
        if not any(stem.startswith(c.removesuffix("$")) or c.startswith(stem) for c in chosen):
            chosen.append(t)
    return sorted(chosen)


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression with an intercept and a ridge penalty, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def features(hits: list[tuple[int, int, bool]], words: int, weights: dict[tuple[int, int], float]) -> list[float]:
    """The strongest hit, the sum of all, and the sum for each word; both sums level off, so that long texts stay in the range that was learned."""
    values = [weights.get((t, e), 0.0) * (QUOTED if quoted else 1.0) for t, e, quoted in hits]
    total = sum(v for v in values if v > 0)
    return [max([0.0, *values]), min(total, 30.0) / 3, min(10 * total / max(words, 1), 5.0)]


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The lexicon, the weight of each (term, edits) and the regression, from a bounded sample of labelled rows."""
    sample = _drawn(docs, labels)

    def lexicon(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = learn_lexicon(r for b in batches for r in zip(b["toxic"], b["text"], strict=True))
        yield pd.DataFrame({"term": pd.Series(found, dtype=object)})

    terms = sorted(r[0] for r in sample.repartition(1).mapInPandas(lexicon, "term string").collect())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = Machine(terms)
        for b in batches:
            found = [hits_of(t, machine) for t in b["text"]]
            yield pd.DataFrame({"toxic": b["toxic"], "words": [n for _, n in found], "hits": [",".join(f"{t}:{e}:{q:d}" for t, e, q in h) for h, _ in found]})

    rows = [(toxic, n, [(int(a), int(b), c == "1") for a, b, c in (x.split(":") for x in hits.split(",") if x)]) for toxic, n, hits in sample.mapInPandas(read, "toxic boolean, words long, hits string").collect()]
    rows.sort()
    size = Counter(r[0] for r in rows)
    held: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for toxic, _, hits in rows:
        held[toxic].update({(t, e) for t, e, _ in hits})
    weights = {}
    for t, term in enumerate(terms):
        for e in range(edits_for(term) + 1):
            bad, good = held[True][t, e], held[False][t, e]
            weights[t, e] = math.log((bad + 1) / (size[True] + 2)) - math.log((good + 0.2) / (size[False] + 0.4))
    w = [0.0, 0.0, 0.0, -3.0]
    if size[True] and size[False]:
        w = _fit(np.array([features(h, n, weights) for _, n, h in rows]), np.array([float(r[0]) for r in rows])).tolist()
    return {"terms": terms, "weights": weights, "w": w}


@lru_cache(maxsize=1)
def _machine(terms: tuple[str, ...]) -> Machine:
    return Machine(list(terms))


def score_text(text: str, model: dict) -> float:
    """The score of one text, from 0 to 1."""
    hits, words = hits_of(text, _machine(tuple(model["terms"])))
    z = float(np.dot([*features(hits, words, model["weights"]), 1.0], model["w"]))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def scored(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: row (struct of all input columns), score from 0 to 1.

    Null and empty texts have no hit and score as any text without one; a model trained without both classes
    gives every text the same low score.  Repeated rows score alike.
    """

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([score_text(t, model) for t in texts], dtype="float64")

    return docs.select(row_of(docs).alias("row"), vectorized(score, "double")(text_of(text_col)).alias("score"))


def drop_toxic(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs without those that score 0.5 or more; columns unchanged."""
    return scored(docs, model, text_col=text_col).where("score < 0.5").select("row.*")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return scored(docs, model).select("row.doc_id", (bucket_of("row.doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
