"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints of 64 bits link at a few differing bits.  The bits are grouped into partitions, correlated ones
together; partition i gets a threshold t_i, and if the thresholds sum to d - m + 1 over m partitions, any two
fingerprints at d or fewer differing bits agree to within t_i bits in some partition i.  The number of
partitions and their thresholds are allocated by dynamic programming on candidate counts estimated from
statistics of all fingerprints.  Every fingerprint is dealt to the buckets its parts probe; buckets with few
fingerprints are verified pair by pair.  The fingerprints of a crowded bucket are linked without pairs: two values at two
or fewer differing bits share a value at one or no differing bit from both, so each emits those 65 values and
is linked to the least that emits the same one.  No link is lost, and rows stay in proportion to the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoscope.llm.common import materialize, release, small, text_of, vectorized
from phonoscope.llm.graph import components

BITS = 64
SEED = 42
#: Shingles hashed at once, which bounds memory for long texts.
CHUNK = 1 << 15
#: A bucket with more fingerprints than this is linked by shared midpoints instead of pairs.
CROWD = 48
#: What a probe costs besides its rows, in rows: it is an expression in the plan.
PROBE = 2000


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (unsigned) have each bit set."""
    bits = np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def _most(ones: np.ndarray, count: int) -> int:
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have set."""
    return _most(sum((_ones(hashes[at : at + CHUNK]) for at in range(0, len(hashes), CHUNK)), np.zeros(BITS, dtype=np.int64)), len(hashes))


def fingerprint(words: list[bytes], width: int) -> int:
    """Majority bits of the XXH64 of each shingle of `width` words, repeats included; no word gives zero."""
    count = max(1, len(words) - width + 1) if words else 0
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, count, CHUNK):
        part = words[at : at + CHUNK + width - 1]
        shingles = map(b" ".join, zip(*[part[k:] for k in range(width)], strict=False)) if len(part) >= width else [b" ".join(part)]
        ones += _ones(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8"))
    return _most(ones, count)


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def with_fingerprints(docs: DataFrame, text_col: str, width: int, keep: dict) -> DataFrame:
    """The columns of `keep` (name: expression) and fp, the text's fingerprint as a signed long."""

    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t.encode("utf-8", "replace").lower().split(), width)) for t in texts], dtype="int64")

    return docs.select(*[e.alias(n) for n, e in keep.items()], vectorized(fp, "long")(text_of(text_col)).alias("fp"))


def _bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and for each pair of bits how many have both set."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(batch["fp"].to_numpy(dtype="<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        cells = np.flatnonzero(both)
        yield pd.DataFrame({"cell": np.append(cells, -1), "n": np.append(both.ravel()[cells], n).astype("int64")})

    rows = fps.select("fp").mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most 4,097
    both, n = np.zeros(BITS * BITS), 0
    for cell, value in rows:
        if cell < 0:
            n = value
        else:
            both[cell] = value
    return n, both.reshape(BITS, BITS)


def partition_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of nearly equal size: each starts from the free bits' most correlated and takes the next most correlated."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    related = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts, 0, -1):
        size = len(free) // k
        group = [free[int(related[np.ix_(free, free)].sum(axis=1).argmax())]]
        while len(group) < size:
            rest = [b for b in free if b not in group]
            group.append(rest[int(related[np.ix_(rest, group)].sum(axis=1).argmax())])
        groups.append(sorted(group))
        free = [b for b in free if b not in group]
    return groups


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one for each partition out of its dict's keys, that sum to `total` at the least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, more in options.items():
                if spent + t not in step or cost + more < step[spent + t][0]:
                    step[spent + t] = (cost + more, [*chosen, t])
        best = step
    return best.get(total, (float("inf"), []))


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def probes(fps: DataFrame, distance: int) -> list[tuple[int, int, list[int]]]:
    """(partition, mask of its bits, masks to flip) of the cheapest allocation for these fingerprints."""
    n, both = _bit_counts(fps)
    share = np.diag(both) / max(n, 1)
    same = np.clip(share**2 + (1 - share) ** 2, 1e-9, 1)
    plans = {m: partition_bits(n, both, m) for m in range(1, distance + 2)}
    keys = [(m, i, _mask(bits)) for m, groups in plans.items() for i, bits in enumerate(groups) if m > 1]
    measured: dict[tuple[int, int], float] = {}
    if keys:
        sides = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v")) for k, (_, _, mask) in enumerate(keys)]))
        crowd = fps.select(sides.alias("s")).groupBy("s.k", "s.v").agg(F.count("*").cast("double").alias("c")).groupBy("k").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("pairs"))
        measured = {keys[k][:2]: pairs for k, pairs in crowd.collect()}  # a few rows
    best: tuple[float, int, list[int]] = (float("inf"), 1, [distance])
    for m, groups in plans.items():
        costs = []
        for i, bits in enumerate(groups):
            odds = float(((1 - same[bits]) / same[bits]).sum())
            pairs, options, flips, reach = measured.get((m, i), 0.0) + 1e-3, {-1: 0.0}, 1.0, 1.0
            for t in range(distance - m + 2 if m > 1 else distance + 1):
                if t:
                    flips += float(_choose(len(bits), t))
                    reach += odds**t / _factorial(t)
                options[t] = (n + PROBE) * flips + pairs * reach / 8
            costs.append(options)
        cost, chosen = allocate(costs, distance - m + 1)
        if cost < best[0]:
            best = (cost, m, chosen)
    _, m, chosen = best
    return [(i, _mask(bits), [_mask(list(f)) for r in range(t + 1) for f in combinations(bits, r)]) for i, (bits, t) in enumerate(zip(plans[m], chosen, strict=True)) if t >= 0]


def _choose(n: int, k: int) -> int:
    return _factorial(n) // _factorial(k) // _factorial(n - k)


def _factorial(n: int) -> int:
    return n * _factorial(n - 1) if n > 1 else 1


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp) that connect exactly what pairs at `distance` or fewer differing bits connect."""
    if not 0 <= distance <= 2:
        raise ValueError("midpoints link crowded buckets exactly for distances up to 2")
    spots = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask)).bitwiseXOR(F.lit(flip)).alias("v"), F.lit(flip == 0).alias("own")) for i, mask, flips in probes(fps, distance) for flip in flips])
    dealt = fps.select("fp", F.explode(spots).alias("s")).select("fp", "s.*")
    sizes = dealt.groupBy("i", "v").agg(F.count("*").alias("n"), F.max("own").alias("owned")).where("n > 1 and owned").drop("owned")
    shared = materialize(dealt.join(small(materialize(sizes), 24), ["i", "v"]))
    few = shared.where(F.col("n") <= CROWD).groupBy("i", "v").agg(F.collect_list(F.struct("fp", "own")).alias("all"))
    near = lambda x: lambda y: (y["fp"] > x["fp"]) & (x["own"] | y["own"]) & (F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= distance)
    pairs = F.flatten(F.transform("all", lambda x: F.transform(F.filter("all", near(x)), lambda y: F.struct(x["fp"].alias("u"), y["fp"].alias("v")))))
    found = few.select(F.explode(pairs).alias("p")).select("p.u", "p.v")
    out = materialize(found.unionByName(_by_midpoints(shared.where(F.col("n") > CROWD).select("fp").distinct(), distance)).distinct())
    release(shared)
    return out


def _by_midpoints(fps: DataFrame, distance: int) -> DataFrame:
    if distance < 2:  # at one bit the neighbours themselves are the meeting points
        flips = F.array(*[F.lit(0)] + [F.lit(_signed(1 << b)) for b in range(BITS)] * distance)
        near = fps.select("fp", F.explode(flips).alias("f")).select(F.col("fp").alias("u"), F.col("fp").bitwiseXOR(F.col("f")).alias("v"))
        return near.join(fps.select(F.col("fp").alias("v")), "v", "left_semi").where("u <> v").select("u", "v")
    flips = F.array(*[F.lit(0)] + [F.lit(_signed(1 << b)) for b in range(BITS)])
    around = materialize(fps.select("fp", F.explode(flips).alias("f")).select("fp", F.col("fp").bitwiseXOR(F.col("f")).alias("mid")))
    least = around.groupBy("mid").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("mid", "v")
    return around.join(small(materialize(least), 16), "mid").where("fp <> v").select(F.col("fp").alias("u"), "v")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """One row per input row: id, fp (signed long), component_id (the smallest id that links reach).

    A null or wordless text has fingerprint zero and links as any other; rows with one text share a
    fingerprint; null ids count for a component only where it has no other; an empty table gives an empty result.
    """
    found = materialize(with_fingerprints(docs, text_col, width, {"id": F.col(f"`{id_col}`")}))
    fps = materialize(found.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(fps, distance)).select(F.col("node").alias("fp"), "root")
    rooted = fps.join(small(materialize(roots), 16), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(small(materialize(least), 16), "root").select("fp", "component_id")
    return found.join(small(materialize(named), 16), "fp")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return near_groups(docs).select(F.col("id").alias("doc_id"), hexed, "component_id")
