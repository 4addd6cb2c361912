"""Suffix-array dedup: depth-limited radix sort of suffixes over the bytes of the whole corpus.

Suffixes are told apart only through LENGTH bytes, by most-significant-digit passes whose groups of one leave, so that the
groups left in the end are exactly the repeated windows.  Which digit comes first is free, and ours is chosen so that few
suffixes need to travel: of the GRAM-byte strings in a window the one with the least hash (the leftmost, on ties) is
its first digit, which depends on the window's bytes alone.  Neighbouring windows with one such anchor form a run and
travel as one row.  The second digit is the whole run, by a 64-bit digest that only runs of one anchor are compared by: a run that has
appeared before repeats as a whole.  Only distinct runs that share
an anchor are then split into windows, and those sorted by the digits left, in the task that holds the
anchor's few runs, or, for an anchor with very many, by passes over the cluster that halve the windows of a run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phonoscope.llm.common import BROADCAST_BYTES, materialize, small, vectorized, with_rid

#: Bytes of a repeated string, bytes of an anchor, and bytes of a digit in the last passes.
LENGTH, GRAM, DIGIT = 100, 24, 50
#: An anchor with more distinct runs than this is sorted by passes over the cluster.
CROWD = 64
#: An anchor with more occurrences than this is not gathered in one task.
HOT = 10000
#: Bytes that are scanned for anchors at once.
SLICE = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on."""
    n = len(data) - GRAM + 1
    with np.errstate(over="ignore"):
        step, have, left, at, scale, power = data.astype(np.uint64) + np.uint64(1), 1, GRAM, 0, np.uint64(1), _MIX
        out = np.zeros(n, dtype=np.uint64)
        while left:
            if left & 1:
                out += step[at : at + n] * scale
                scale, at = scale * power, at + have
            left >>= 1
            if left:
                step = step[:-have] + step[have:] * power
                power, have = power * power, have * 2
        out *= _MIX
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values."""
    have = 1
    n = len(values) - width + 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[:n], values[width - have : width - have + n])


def runs(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text the runs of windows with one anchor: anchor hash, run hash, first start, windows * 256 + the anchor's offset."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
    out: list = [none] * len(texts)
    group: list[tuple[int, int, bytes]] = []
    size = 0
    for k, text in enumerate(texts):
        for at in range(0, max(len(text) - LENGTH + 1, 0), SLICE):  # slices of a long text overlap by a window less one byte
            part = text[at : at + SLICE + LENGTH - 1]
            group.append((k, at, part))
            size += len(part)
            if size >= SLICE:
                _scan(group, out)
                group, size = [], 0
    if group:
        _scan(group, out)
    return out


def _scan(group: list[tuple[int, int, bytes]], out: list) -> None:
    joined = b"".join(p for _, _, p in group)
    data = np.frombuffer(joined, dtype=np.uint8)
    hashes = _gram_hashes(data)
    packed = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (_least(packed, LENGTH - GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.cumsum([0] + [len(p) for _, _, p in group])
    for (k, at, part), begin in zip(group, first[:-1], strict=True):
        own = anchor[begin : begin + len(part) - LENGTH + 1]
        starts = np.append(0, np.flatnonzero(own[1:] != own[:-1]) + 1)
        counts = np.diff(np.append(starts, len(own)))
        offset = own[starts] - begin - starts
        whole = np.fromiter((xxhash.xxh3_64_intdigest(part[s : s + c + LENGTH - 1], o) for s, c, o in zip(starts.tolist(), counts.tolist(), offset.tolist(), strict=True)), dtype=np.uint64, count=len(starts))
        new = (hashes[own[starts]].view(np.int64), whole.view(np.int64), (starts + at).astype(np.int32), (counts * 256 + offset).astype(np.int32))
        out[k] = tuple(np.concatenate([a, b]) for a, b in zip(out[k], new, strict=True)) if len(out[k][0]) else new


def _runs_of(texts: pd.Series) -> pd.DataFrame:
    found = runs([t.encode("utf-8", "replace") for t in texts])
    return pd.DataFrame({name: [f[i] for f in found] for i, name in enumerate("arsc")})


_runs = vectorized(_runs_of, "struct<a: array<bigint>, r: array<bigint>, s: array<int>, c: array<int>>")


def repeated_windows(strings: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, int]]:
    """(rid, first byte, byte after the last) of windows of these runs (rid, start, anchor's offset, bytes) that begin earlier elsewhere.

    Digits, from the most significant: the window's place about the anchor, then DIGIT bytes at a time up to LENGTH.
    """
    groups: list[list[tuple[int, int, bytes, int]]] = []
    by_place: dict[int, list[tuple[int, int, bytes, int]]] = {}
    for rid, start, offset, data in sorted(strings):
        for i in range(len(data) - LENGTH + 1):
            by_place.setdefault(offset - i, []).append((rid, start + i, data, i))
    groups = [g for g in by_place.values() if len(g) > 1]
    for depth in range(0, LENGTH, DIGIT):
        split: list[list[tuple[int, int, bytes, int]]] = []
        for group in groups:
            parts: dict[bytes, list[tuple[int, int, bytes, int]]] = {}
            for member in group:
                i = member[3] + depth
                parts.setdefault(member[2][i : i + min(DIGIT, LENGTH - depth)], []).append(member)
            split += [p for p in parts.values() if len(p) > 1]
        groups = split
    found = sorted((rid, start) for g in groups for rid, start, _, _ in sorted(g, key=lambda m: m[:2])[1:])
    return merged([(rid, s, s + LENGTH) for rid, s in found])


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Sorted spans (rid, first, after), those that touch joined."""
    out: list[tuple[int, int, int]] = []
    for rid, a, b in spans:
        if out and out[-1][0] == rid and a <= out[-1][2]:
            out[-1] = (rid, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((rid, a, b))
    return out


def _sorted_here_of(groups: pd.Series) -> pd.Series:
    return pd.Series([[{"rid": r, "b": a, "e": b} for r, a, b in repeated_windows([(m["rid"], m["s"], m["o"], bytes(m["data"])) for m in g])] for g in groups])


_sorted_here = vectorized(_sorted_here_of, "array<struct<rid: bigint, b: int, e: int>>")


def _cut_of(texts: pd.Series, regions: pd.Series) -> pd.Series:
    out = []
    for text, own in zip(texts, regions, strict=True):
        data = text.encode("utf-8", "replace")
        out.append([data[m["s"] : m["s"] + (m["c"] >> 8) + LENGTH - 1] for m in own])
    return pd.Series(out)


_cut = vectorized(_cut_of, "array<binary>")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """rid, spans (array of struct b, e; sorted, apart): bytes of texts (columns rid, text) that an earlier equal window covers."""
    found = materialize(texts.where(F.octet_length("text") >= LENGTH).select("rid", _runs("text").alias("f")).select("rid", "f.*"))
    found = found.select("rid", F.inline(F.arrays_zip("a", "r", "s", "c")))
    # First digit: anchors that occur once leave.
    again = materialize(found.groupBy("a").agg(F.count("*").alias("n")).where("n > 1"))
    alive = materialize(found.join(again.select("a", (F.col("n") > HOT).alias("hot")), "a"))
    # Second digit: of equal runs the first goes on; all others repeat it as a whole.
    marked = _second_digit(alive.where("not hot"))
    repeats = marked.where("not first").select("rid", "s", "c")
    hot = alive.where("hot").select("a", "r", "rid", "s", "c")
    hot_firsts = materialize(_firsts(hot, ["a", "r"]))
    repeats = materialize(repeats.unionByName(_others(hot, hot_firsts, ["rid", "s"], ["c"]).select("rid", "s", "c")))
    many = small(materialize(hot_firsts.groupBy("a").agg(F.count("*").alias("m"))), 16)
    firsts = marked.where("first and m > 1").select("a", "m", "rid", "s", "c").unionByName(hot_firsts.join(many, "a").where("m > 1").select("a", "m", "rid", "s", "c"))
    whole = repeats.select("rid", F.col("s").alias("b"), (F.col("s") + F.shiftright("c", 8) + LENGTH - 1).alias("e"))
    # Distinct runs that share an anchor go on, with their bytes.
    contested = firsts.groupBy("rid").agg(F.collect_list(F.struct("a", "m", "s", "c")).alias("own"))
    cut = texts.join(contested, "rid").select("rid", F.inline(F.arrays_zip("own", _cut("text", "own").alias("data"))))
    cut = materialize(cut.select("rid", "own.a", "own.m", "own.s", F.col("own.c").bitwiseAND(255).alias("o"), "data"))
    spans = whole.unionByName(_in_tasks(cut.where(F.col("m") <= CROWD), ["a"])).unionByName(_over_cluster(cut.where(F.col("m") > CROWD)))
    return materialize(spans.groupBy("rid").agg(F.collect_list(F.struct("b", "e")).alias("all")).select("rid", _joined_up("all").alias("spans")))


def _second_digit(rows: DataFrame) -> DataFrame:
    """rows with first (whether no equal run is before) and m (distinct runs with the anchor), for anchors of bounded occurrence."""
    equal = Window.partitionBy("a", "r").orderBy("rid", "s")
    rows = rows.withColumn("first", F.row_number().over(equal) == 1)
    return materialize(rows.withColumn("m", F.sum(F.col("first").cast("long")).over(Window.partitionBy("a"))).where("not first or m > 1").select("a", "rid", "s", "c", "first", "m"))


def _firsts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key by rid and start; rows are combined before the shuffle."""
    rest = [c for c in rows.columns if c not in (*keys, "rid", "s")]
    return rows.groupBy(*keys).agg(F.min(F.struct("rid", "s", *rest)).alias("f")).select(*keys, "f.*")


def _others(rows: DataFrame, firsts: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """The rows that are not among the firsts; `names` tell rows apart."""
    tagged = rows.select(*names, *keep, F.lit(0).alias("tag")).unionByName(firsts.select(*names, *keep, F.lit(1).alias("tag")))
    return tagged.groupBy(*names).agg(F.max("tag").alias("tag"), *[F.max(c).alias(c) for c in keep]).where("tag = 0").drop("tag")


def _in_tasks(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of repeated windows of runs whose groups are few enough to be sorted each in one task."""
    groups = runs.groupBy(*keys).agg(F.collect_list(F.struct("rid", "s", "o", "data")).alias("g"))
    return groups.select(F.inline(_sorted_here("g"))).select("rid", "b", "e")


def _over_cluster(runs: DataFrame) -> DataFrame:
    """Spans of repeated windows of crowded groups, by passes over the cluster.

    A pass has windows whose places about the anchor lie in a range.  Runs with equal bytes for all of the range are
    equal windows throughout: the first goes on, the others repeat it.  The rest is dealt by the bytes that all
    windows of the range share; groups of one leave, small ones are sorted in a task, and crowded ones go on with
    either half of the range, down to single places, where equal bytes are equal windows.
    """
    low = F.col("o") - F.octet_length("data") + LENGTH
    rows = materialize(runs.select("a", low.alias("low"), F.col("o").alias("high"), "rid", "s", "o", "data"))
    spans = rows.select("rid", F.col("s").alias("b"), F.col("s").alias("e")).limit(0)
    width = LENGTH - GRAM + 1
    while not rows.isEmpty():
        # A run's share of each range, from low to high: its bytes begin at s, and the anchor is high bytes on.
        rows = rows.withColumn("part", F.explode(F.sequence(F.floor(F.col("low") / width).cast("int"), F.floor(F.col("high") / width).cast("int"))))
        rows = rows.withColumns({"low": F.greatest("low", F.col("part") * width), "high": F.least("high", F.col("part") * width + width - 1)})
        cut = F.expr(f"substring(data, o - high + 1, high - low + {LENGTH})")
        rows = materialize(rows.select("a", "part", "low", "high", "rid", (F.col("s") + F.col("o") - F.col("high")).alias("s"), cut.alias("data")))
        firsts = materialize(_firsts(rows, ["a", "part", "low", "high", "data"]))
        later = _others(rows, firsts, ["rid", "s"], ["low", "high"])
        spans = spans.unionByName(later.select("rid", F.col("s").alias("b"), (F.col("s") + F.col("high") - F.col("low") + LENGTH).alias("e")))
        if width == 1:
            break
        # What all windows of the range have: from its nearest place before the anchor, so many bytes on.
        core = F.expr(f"substring(data, high - part * {width} + 1, {LENGTH - width + 1})")
        firsts = firsts.withColumn("core", core).withColumn("o", F.col("high"))
        sizes = materialize(firsts.groupBy("a", "part", "core").agg(F.count("*").alias("m")).where("m > 1"))
        firsts = materialize(firsts.join(sizes, ["a", "part", "core"]))
        spans = spans.unionByName(_in_tasks(firsts.where(F.col("m") <= CROWD), ["a", "part", "core"]))
        rows = firsts.where(F.col("m") > CROWD).select("a", "low", "high", "rid", "s", "o", "data")
        width = -(-width // 2)
    return spans


def _joined_up_of(spans: pd.Series) -> pd.Series:
    return pd.Series([[{"b": b, "e": e} for _, b, e in merged(sorted((0, m["b"], m["e"]) for m in own))] for own in spans])


_joined_up = vectorized(_joined_up_of, "array<struct<b: int, e: int>>")


def _bounded(table: DataFrame, array: str, item_bytes: int) -> DataFrame:
    """Broadcast a written table with an array column only if all its items fit the bound."""
    rows, items = table.agg(F.count("*"), F.sum(F.size(array))).first()
    return F.broadcast(table) if rows * 32 + (items or 0) * item_bytes <= BROADCAST_BYTES else table


def _remainder(texts: Iterator, spans: Iterator) -> Iterator[tuple[int, int, int, str]]:
    for text, own in zip(texts, spans, strict=True):
        data, sha, at, gone = text.encode("utf-8", "replace"), hashlib.sha256(), 0, 0
        own = [] if own is None else own
        for m in own:
            sha.update(data[at : m["b"]])
            at, gone = m["e"], gone + m["e"] - m["b"]
        sha.update(data[at:])
        yield len(data), gone, len(own), sha.hexdigest()


def _report_of(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(list(_remainder(texts, spans)), columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])


_report = vectorized(_report_of, "struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept_sha256: string>")


def _kept_of(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, own in zip(texts, spans, strict=True):
        data, at, parts = text.encode("utf-8", "replace"), 0, []
        for m in [] if own is None else own:
            parts.append(data[at : m["b"]])
            at = m["e"]
        out.append(b"".join([*parts, data[at:]]))
    return pd.Series(out)


_kept = vectorized(_kept_of, "binary")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: row (struct of all input columns), spans (removed bytes, null where none), kept (remaining bytes, binary).

    A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a row before (by id, null
    first; equal ids by text) or earlier in the row.  Null counts as empty; texts under LENGTH bytes stay whole.
    """
    texts = with_rid(docs, id_col, text_col)
    spans = repeated_spans(texts)
    return texts.join(_bounded(spans, "spans", 16), "rid", "left").select("row", "spans", _kept("text", "spans").alias("kept"))


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    texts = with_rid(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id", "text")
    spans = repeated_spans(texts)
    return texts.join(_bounded(spans, "spans", 16), "rid", "left").select("row.doc_id", _report("text", "spans").alias("o")).select("doc_id", "o.*")


ORACLE = {
    "op8_suffix_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, b[i + 1:i + 100] AS s FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 99)) AS i FROM d WHERE octet_length(b) >= 100)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
marked AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, TRUE) AS fresh FROM again),
numbered AS (SELECT doc_id, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, min(i) AS b, max(i) + 100 AS e FROM numbered GROUP BY doc_id, run),
gone AS (SELECT doc_id, list([b, e] ORDER BY b) AS gone, CAST(sum(e - b) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
cut AS (SELECT d.doc_id, d.b, n_removed, n_spans, list_concat([0], list_transform(coalesce(gone, []), lambda g: g[2])) AS f,
               list_concat(list_transform(coalesce(gone, []), lambda g: g[1]), [octet_length(d.b)]) AS t
        FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(list_reduce(list_transform(list_zip(f, t), lambda p: b[p[1] + 1:p[2]]), lambda x, y: x || y)) AS kept_sha256
FROM cut
"""
}
