"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed to a fixed number of features.  Document frequencies come from
every row that may be learned from; the regression is fitted by follow-the-regularised-leader with an
elastic-net penalty, whose first part leaves most weights at zero, on a bounded sample drawn by a hash of the
id; a temperature fitted on a part of the sample kept aside calibrates the scores.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoscope.llm.common import bucket_of, materialize, row_of, text_of, vectorized

#: Features that n-grams are hashed to, and the longest n-gram.
FEATURES, LONGEST = 1 << 15, 3
#: About so many rows in all are drawn to fit the regression, by a hash of their id and text; every fifth sets the temperature.
SAMPLE, ASIDE = 3000, 5
#: Follow-the-regularised-leader: learning rate, its smoothing, the two penalties, and passes over the sample.
RATE, SMOOTH, LASSO, RIDGE, PASSES = 0.5, 1.0, 0.002, 0.001, 4
#: The answer for a text that is null or has no letter.
UNKNOWN = "und"
_CHUNK = 1 << 20


def ngram_counts(text: str) -> np.ndarray:
    """Occurrences of each feature in the whole text: hashed n-grams of its lower-cased words, with their borders."""
    counts = np.zeros(FEATURES, dtype=np.int64)
    words = f" {' '.join(text.lower().split())} "
    for at in range(0, max(1, len(words) - LONGEST + 1), _CHUNK):
        part = words[at : at + _CHUNK + LONGEST - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        own = min(_CHUNK, len(codes)) if at + _CHUNK < len(words) - LONGEST + 1 else len(codes)
        rolled = np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, LONGEST + 1):
            if len(codes) < n:
                break
            with np.errstate(over="ignore"):
                rolled = rolled[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
                spread = rolled * np.uint64(0xD6E8FEB86659FD93)
            counts += np.bincount((spread >> np.uint64(49)).astype(np.int64)[:own], minlength=FEATURES)
    return counts


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, values) of a text: logarithmic term frequency times inverse document frequency, of length one."""
    counts = ngram_counts(text)
    held = np.flatnonzero(counts)
    values = (1 + np.log(counts[held])) * idf[held]
    norm = np.sqrt((values**2).sum())
    return held, values / norm if norm > 0 else values


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """The number of texts (column text), and in how many each feature occurs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = np.zeros(FEATURES, dtype=np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                held += ngram_counts(text) > 0
                n += 1
        cells = np.flatnonzero(held)
        yield pd.DataFrame({"cell": np.append(cells, -1), "n": np.append(held[cells], n)})

    df, n = np.zeros(FEATURES), 0
    for cell, value in texts.mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row for each feature
        if cell < 0:
            n = value
        else:
            df[cell] = value
    return n, df


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights (classes by features and an intercept) by follow-the-regularised-leader, proximal, one row at a time."""
    z, n = np.zeros((classes, FEATURES + 1)), np.zeros((classes, FEATURES + 1))
    order = np.random.default_rng(0)
    for _ in range(PASSES):
        for k in order.permutation(len(rows)):
            held, values, label = rows[k]
            held, values = np.append(held, FEATURES), np.append(values, 1.0)
            w = _weights(z[:, held], n[:, held])
            p = _softmax(w @ values)
            p[label] -= 1
            g = p[:, None] * values
            square = n[:, held] + g * g
            z[:, held] += g - (np.sqrt(square) - np.sqrt(n[:, held])) / RATE * w
            n[:, held] = square
    return _weights(z, n)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The leader under both penalties: zero where the first outweighs what was seen."""
    return np.where(np.abs(z) <= LASSO, 0.0, -(z - np.sign(z) * LASSO) / ((SMOOTH + np.sqrt(n)) / RATE + RIDGE))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits under which the labels are likeliest, by golden-section search over its logarithm."""

    def loss(t: float) -> float:
        x = logits / np.exp(t)
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(labels)), labels]).sum())

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> dict:
    """Languages, document frequencies, weights and temperature; docs are the rows that may be learned from."""
    known = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), text_of(text_col).alias("text")).where("lang is not null")
    total, df = document_frequencies(known.select("text"))
    idf = np.log((1 + total) / (1 + df)) + 1
    tally = known.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = {r[0]: r[1] for r in tally.collect()}  # a row for each language
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "idf": _packed(idf), "w": "", "t": 1.0}
    u = F.pmod(F.xxhash64(F.col("id").cast("string"), F.col("text"), F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    limit = F.coalesce(F.element_at(F.create_map(*[x for g in langs for x in (F.lit(g), F.lit(SAMPLE / len(langs) / sizes[g]))]), F.col("lang")), F.lit(0.0))
    sample = materialize(known.where(u < limit).distinct())  # rows that repeat with id and text count once
    fixed = _packed(idf)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_idf, place = _unpacked(fixed), {g: k for k, g in enumerate(langs)}
        rows = sorted((r for b in batches for r in zip(b["id"].astype(str), b["lang"], [vector(t, own_idf) for t in b["text"]], strict=True)), key=lambda r: r[:2])
        data = [(held.astype(np.int64), values, place[lang]) for _, lang, (held, values) in rows]
        aside, used = data[::ASIDE], [d for k, d in enumerate(data) if k % ASIDE]
        w = fit(used or data, len(langs))
        logits = np.array([w[:, np.append(held, FEATURES)] @ np.append(values, 1.0) for held, values, _ in aside])
        t = temperature(logits, np.array([label for _, _, label in aside])) if len(aside) else 1.0
        yield pd.DataFrame({"w": [_packed(w)], "t": [max(t, 0.05)]})

    w, t = sample.repartition(1).mapInPandas(learn, "w string, t double").first()
    return {"langs": langs, "idf": fixed, "w": w, "t": t}


def _packed(values: np.ndarray) -> str:
    return base64.b64encode(values.astype("<f4").tobytes()).decode()


def _unpacked(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype="<f4")


@lru_cache(maxsize=2)
def _ready(idf: str, w: str, classes: int) -> tuple[np.ndarray, np.ndarray]:
    return _unpacked(idf), _unpacked(w).reshape(classes, FEATURES + 1)


def predict(text: str, model: dict) -> tuple[str, float]:
    """The likeliest language and its calibrated probability."""
    if not model["langs"] or not has_letter(text):
        return UNKNOWN, 0.0
    idf, w = _ready(model["idf"], model["w"], len(model["langs"]))
    held, values = vector(text, idf)
    p = _softmax((w[:, held] @ values + w[:, FEATURES]) / model["t"])
    k = int(p.argmax())
    return model["langs"][k], float(p[k])


def identified(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """One row per input row: row (struct of all input columns), lang_pred, score.

    Of equally likely languages the first by code point is given.  Null texts and texts without a letter are `und` with score 0, and so is every text if no language was learned.
    """

    def best(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([predict(t, model) for t in texts], columns=["lang_pred", "score"])

    guess = vectorized(best, "struct<lang_pred: string, score: double>")
    return docs.select(row_of(docs).alias("row"), guess(text_of(text_col)).alias("g")).select("row", "g.*")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = bucket_of("doc_id", 3) == 1
    model = train(docs.where(~held_out))
    return identified(docs.select("doc_id", "text"), model).select("row.doc_id", (bucket_of("row.doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
