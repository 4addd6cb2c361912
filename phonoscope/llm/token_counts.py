"""Token counts by finite-state compilation of a byte-level BPE tokenizer.

Two deterministic machines are compiled from the tokenizer's file.  The first reads classes of
characters and marks where words (pre-tokens) begin; texts are cut into chunks, the map from every entry state
to its exit state is computed for all chunks at once, and the maps are composed by a parallel prefix scan, which
gives each chunk its entry state.  The second reads the bytes of a word; every transition is annotated with the
number of tokens it emits, so a word's count is the sum along its path.  Its states are determinised as they
are met.  They rest on this: for each prefix of a word the last token of its encoding is the one
token that ends there and may follow the last token of the rest, and whether one token may follow
another is decided by the merges on both sides of their seam.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoscope.llm.common import text_of, vectorized

#: Tokens above which a text is over the limit.
LIMIT = 512
#: Characters of a chunk; characters of texts that are scanned together.
CHUNK, SLICE = 128, 1 << 19
#: States and words remembered in each Python worker before it starts afresh, and characters of the longest such word.
STATES, WORDS, LONG_WORD = 1 << 18, 1 << 18, 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---- the machine that marks where words begin ----

#: Classes of characters: letter, number, space, other white space, apostrophe, other; letters that can follow an apostrophe;
#: the end of a text, for which a code point beyond all characters stands.
LETTER, NUMBER, SPACE, WHITE, QUOTE, OTHER, S, T, R, V, M, L, D, E, BREAK = range(15)
_CLASSES = 15
_END = np.array([sys.maxunicode + 1], dtype="<u4")
_WHITE = {0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
#: States: what the word under way is.  A pending space or white space character may still join what follows; after an
#: apostrophe that begins a word the next letters may make it a contraction, which one or two characters decide.
(START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_SPACE, ONE_WHITE, QUOTED, HALF_R, HALF_V, HALF_L, CLOSED) = range(11)
_STATES = 11
#: Where a word begins when a character is read: nowhere, at it, one before it, or two before and at none of those.
_NONE, _HERE, _BEFORE, _BOTH, _TWO = 0, 1, 2, 3, 4


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point."""
    table = np.full(sys.maxunicode + 2, OTHER, dtype=np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
    table[list(_WHITE)] = WHITE
    table[0x20], table[0x27], table[_END] = SPACE, QUOTE, BREAK
    for letter, of in zip("strvmlde", (S, T, R, V, M, L, D, E), strict=True):
        table[ord(letter)] = of
    return table


@lru_cache(maxsize=1)
def word_machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by state and class."""
    move, mark = np.zeros((_STATES, _CLASSES), dtype=np.uint8), np.zeros((_STATES, _CLASSES), dtype=np.uint8)

    def family(c: int) -> int:
        return LETTER if c == LETTER or c > OTHER else OTHER if c == QUOTE else c

    opened = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SPACE: ONE_SPACE, WHITE: ONE_WHITE}
    for state in range(_STATES):
        move[state, BREAK], mark[state, BREAK] = START, _HERE
        for c in range(BREAK):
            kind = family(c)
            fresh = QUOTED if c == QUOTE else opened[kind]
            to, at = fresh, _HERE  # a new word begins at this character
            if (state, kind) in ((IN_LETTERS, LETTER), (IN_NUMBERS, NUMBER), (IN_OTHERS, OTHER)):
                to, at = state, _NONE
            elif state == ONE_SPACE:  # the word so far is white space whose last character, a space, is still free
                if kind in (LETTER, NUMBER, OTHER):
                    to, at = opened[kind], _BEFORE  # the space joins what follows, even an apostrophe
                else:
                    at = _NONE
            elif state == ONE_WHITE:  # the last character is white space that joins nothing
                if kind in (LETTER, NUMBER, OTHER):
                    at = _BOTH
                else:
                    at = _NONE
            elif state == QUOTED:  # an apostrophe began a word
                if c in (S, T, M, D):
                    to, at = CLOSED, _NONE
                elif c in (R, V, L):
                    to, at = {R: HALF_R, V: HALF_V, L: HALF_L}[c], _HERE  # put right by the next character
                elif kind == OTHER:
                    to, at = IN_OTHERS, _NONE
            elif state in (HALF_R, HALF_V, HALF_L):
                if (state, c) in ((HALF_R, E), (HALF_V, E), (HALF_L, L)):
                    to, at = CLOSED, _TWO  # 're, 've, 'll: the letter before begins no word
                elif kind == LETTER:
                    to, at = IN_LETTERS, _NONE
            move[state, c], mark[state, c] = to, at
    return move, mark


def entry_states(classes: np.ndarray) -> np.ndarray:
    """The state before each character: chunk state maps, composed by a prefix scan, then run from their entries."""
    move, _ = word_machine()
    n = len(classes)
    rows = -(-n // CHUNK)
    grid = np.zeros(rows * CHUNK, dtype=np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    flat = move.ravel()
    maps = np.tile(np.arange(_STATES, dtype=np.int16), (rows, 1))
    for column in grid:
        maps = flat[maps * _CLASSES + column[:, None]].astype(np.int16)
    reach = 1
    while reach < rows:  # afterwards row k maps the entry of the first chunk to the exit of chunk k
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    state = np.append(START, maps[:-1, START]).astype(np.int16)
    out = np.empty((CHUNK, rows), dtype=np.uint8)
    for k, column in enumerate(grid):
        out[k] = state
        state = flat[state * _CLASSES + column].astype(np.int16)
    return out.T.ravel()[:n]


def word_starts(text: str) -> np.ndarray:
    """Where words begin, in characters."""
    return _starts(class_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")])


def _starts(classes: np.ndarray) -> np.ndarray:
    n = len(classes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    states = entry_states(classes)
    marks = word_machine()[1][states, classes]
    begins = (marks == _HERE) | (marks == _BOTH)
    begins[:-1] |= (marks[1:] == _BEFORE) | (marks[1:] == _BOTH)
    begins[:-1] &= marks[1:] != _TWO
    begins[0] = True
    return np.flatnonzero(begins)


# ---- the machine that counts the tokens of a word ----


class WordCounter:
    """The byte-pair merges of a tokenizer file as a lazily determinised transducer from bytes to token counts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_supported(spec)
        self.special = [t["content"] for t in spec["added_tokens"]]
        spelled = _byte_letters()
        vocab = {bytes(spelled[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        parent: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            left, right = (vocab[bytes(spelled[c] for c in x)] for x in (a, b))
            whole = vocab[bytes(spelled[c] for c in a + b)]
            self.rank[left, right] = rank
            parent.setdefault(whole, (left, right))
        self.parent = parent
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for text, number in vocab.items():
            if len(text) > 1 and number not in parent:
                continue  # no merge makes it
            node = 0
            for b in text:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][b]
            self.token[node] = number
        self.spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.words: dict[str, int] = {}
        self._afresh()

    def _afresh(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self._state(((0, -1, 0),))

    def _state(self, active: tuple) -> int:
        if active not in self.ids:
            self.ids[active] = len(self.states)
            self.states.append(active)
            self.moves.append({})
        return self.ids[active]

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one end of a token (0 left, 1 right), from a byte up, each with the rank at which the next takes it in."""
        if (token, side) not in self.spines:
            chain = [token]
            while chain[-1] in self.parent:
                chain.append(self.parent[chain[-1]][side])
            chain.reverse()
            ranks = [self.rank[self.parent[t]] for t in chain[1:]] + [1 << 60]
            self.spines[token, side] = list(zip(chain, ranks, strict=True))
        return self.spines[token, side]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the merges of left and right, in order of rank, finish before any merge across their seam applies.

        Of equal ranks the merge further left comes first: left's own precedes one across the seam, right's own does not.
        """
        known = self.follows.get((left, right))
        if known is None:
            a, b, i, j, known = self._spine(left, 1), self._spine(right, 0), 0, 0, True
            while True:
                (x, rx), (y, ry) = a[i], b[j]
                across = self.rank.get((x, y))
                if across is not None and across < rx and across <= ry:
                    known = False
                    break
                if rx == ry == 1 << 60:
                    break
                if rx <= ry:
                    i += 1
                if ry <= rx:
                    j += 1
            if len(self.follows) >= STATES * 4:
                self.follows.clear()
            self.follows[left, right] = known
        return known

    def _step(self, state: int, b: int) -> tuple[int, int]:
        """The next state and the tokens emitted; a state holds (trie node, last token before it, tokens since then, negated)."""
        grown, last, emitted = [], -1, 0
        for node, before, lag in self.states[state]:
            to = self.child[node].get(b)
            if to is None:
                continue
            grown.append((to, before, lag))
            t = self.token[to]
            if last < 0 and t >= 0 and (before < 0 or self.may_follow(before, t)):
                last, emitted = t, lag + 1
        active = tuple((node, before, lag - emitted) for node, before, lag in grown if self.child[node])
        out = self._state((*active, (0, last, 0))), emitted
        self.moves[state][b] = out
        return out

    def count(self, word: str) -> int:
        """Tokens of one word."""
        known = self.words.get(word)
        if known is None:
            if len(self.states) >= STATES:
                self._afresh()
            state, known, moves = 0, 0, self.moves
            for b in word.encode("utf-8", "replace"):
                to = moves[state].get(b)
                state, emitted = self._step(state, b) if to is None else to
                known += emitted
            if len(self.words) >= WORDS:
                self.words.clear()
            if len(word) <= LONG_WORD:
                self.words[word] = known
        return known

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text; the special tokens' strings count as one token each."""
        pieces, owner, extra = [], [], [0] * len(texts)
        for k, text in enumerate(texts):
            parts = [text]
            for mark in self.special:
                if mark in text:
                    cut = [p.split(mark) for p in parts]
                    extra[k] += sum(len(c) - 1 for c in cut)
                    parts = [p for c in cut for p in c]
            for p in parts:
                pieces.append(p)
                owner.append(k)
        group, size = [], 0
        for k, p in zip(owner, pieces, strict=True):
            group.append((k, p))
            size += len(p)
            if size >= SLICE:
                self._count_group(group, extra)
                group, size = [], 0
        self._count_group(group, extra)
        return extra

    def _count_group(self, group: list[tuple[int, str]], into: list[int]) -> None:
        if not group:
            return
        codes = np.concatenate([x for _, text in group for x in (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), _END)])
        cuts = _starts(class_table()[codes])
        known, begin = self.words.get, 0
        for k, text in group:  # a word begins at each end of a text, too
            first, after = np.searchsorted(cuts, (begin, begin + len(text)))
            total, a = 0, 0
            for b in (cuts[first + 1 : after + 1] - begin).tolist():
                word = text[a:b]
                n = known(word)
                total += self.count(word) if n is None else n
                a = b
            into[k] += total
            begin += len(text) + 1


def check_supported(spec: dict) -> None:
    """Only byte-level BPE with the usual word pattern and without normalisation is compiled."""
    pre = spec["pre_tokenizer"] or {}
    model = spec["model"]
    odd = spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges")
    if odd:
        raise ValueError("not a plain byte-level BPE tokenizer")


def _byte_letters() -> dict[str, int]:
    """The byte for which each letter of a byte-level vocabulary stands: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def counter(path: str) -> WordCounter:
    return WordCounter(path)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for each input row.

    Null and empty texts have no bytes and no tokens.  `path` is a tokenizer file that every executor can read.
    """
    path = path or default_path()

    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series(counter(path).counts(list(texts)), dtype="int64")

    text = text_of(text_col)
    counted = docs.select(F.col(f"`{id_col}`").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), vectorized(tokens, "long")(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs).withColumnRenamed("id", "doc_id")
