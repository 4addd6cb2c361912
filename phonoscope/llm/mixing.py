"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words.  Whole copies that the target certainly holds are allocated first;
the remainder is a fixed-size sample: documents are ranked by their random odds u/(1-u) divided by their inclusion
odds, and taken from the lowest rank up until the remaining words are reached.  Inclusion odds are those of the share
of the source that is needed times a measure of the document, by default the square root of its size, so longer
documents are likelier.  The random number is a digest
of the id and a seed, so reruns agree.  The rank at which a source stops comes from histograms of ranks
(combined before the shuffle), each within one bin of the one before until that bin is small, and only its documents
are ever put in order.  Sources that need no remainder are not ranked at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonoscope.llm.common import WORD, materialize, row_of, small, text_of

#: Weights by rank of the source's name, repeating; share of all words; most copies of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Bits of a rank's place, bits that each histogram tells apart, and documents of a bin that are put in order by one task.
PLACE, STEP, ORDERED = 48, 12, 4096
_TWO52 = float(1 << 52)


def uniform(id_column: Column, seed: str) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 digest of seed and id."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(id_column.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(_TWO52)


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target of each source (one row each; sources in code point order, null last)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(MOST))
    # Sources meet their limit in the order of limit / weight.  A level supposes that those before have met theirs,
    # so it rises up to the first source that stays open and falls after it.
    everyone = Window.partitionBy(F.lit(0))
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everyone) * F.lit(SHARE)
    left = total - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weights = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    sources = sources.withColumn("level", left / weights)
    full = F.col("level") * F.col("weight") >= F.col("most")
    sources = sources.withColumn("open_level", F.max(F.when(~full, F.col("level"))).over(everyone))
    target = F.when(full | F.col("open_level").isNull(), F.col("most")).otherwise(F.col("open_level") * F.col("weight"))
    return sources.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", odds: str | None = None, seed: str = "mix") -> DataFrame:
    """One row per input row: row (struct of all input columns), size, source_size, target, copies, taken.

    size counts words (null text: 0); a null source is a source of its own.  Rows with one id share their random
    number and are ordered by size; of one size they are taken together.  `odds` may name a positive column that multiplies a row's inclusion
    odds in place of the square root of its size.  A source without words has target 0; an empty table gives an empty result.
    """
    sized = docs.select(
        row_of(docs).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
        (F.col(f"`{odds}`").cast("double") if odds else F.lit(None).cast("double")).alias("odds"),
    )
    sized = sized.withColumn("odds", F.coalesce("odds", F.sqrt(F.greatest("size", F.lit(1)))))
    # A source's key is never null, so that the null source joins as any other does.
    sized = sized.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    facts = materialize(sized.select("id", "source", "key", "size", "odds"))
    per = source_targets(facts).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source")
    filled = F.col("source_size") > 0
    per = per.withColumn("whole", F.when(filled, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    per = per.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    per = per.withColumn("share", F.when(filled, F.col("need") / F.col("source_size")).otherwise(F.lit(0.0)))
    per = small(materialize(per), 256)

    # Where each source stops: the first bin whose words reach past what is needed, and in it the first of its bins, until one is small.
    ranked = _ranked(facts, per, seed).where("need > 0")
    stops = per.where("need > 0").select("key", F.lit(0).cast("long").alias("bin"), F.lit(0.0).alias("before"))
    bits = 0
    while bits < PLACE:
        within = ranked.join(small(materialize(stops), 48), "key").where(F.shiftright("place", PLACE - bits) == F.col("bin"))
        bits += STEP
        bins = within.groupBy("key", "need", "before", F.shiftright("place", PLACE - bits).alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        stops = materialize(_first_past(materialize(bins)))
        if (stops.agg(F.max("n")).first()[0] or 0) <= ORDERED:
            break
    per = small(materialize(per.join(stops.select("key", "bin", "before"), "key", "left")), 256)

    # In that bin alone documents are put in order; one is taken if its middle word still is.
    place = F.shiftright("place", PLACE - bits)
    last = _ranked(facts, per, seed).where((F.col("need") > 0) & (place == F.col("bin")))
    last = last.groupBy("key", "need", "before", "rank", "id", "size").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("key").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("middle", F.col("before") + F.sum("words").over(upto) - F.col("words") / 2)
    last = last.where(F.col("middle") <= F.col("need")).groupBy("key").agg(F.max(F.struct("rank", "id", "size")).alias("last"))
    per = small(materialize(per.join(last, "key", "left")), 320)

    chosen = _ranked(sized, per, seed)
    here = F.struct("rank", "id", "size")
    extra = F.when((F.col("need") > 0) & (F.col("size") > 0) & ((place < F.col("bin")) | ((place == F.col("bin")) & (here <= F.col("last")))), 1).otherwise(0)
    chosen = chosen.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(F.lit(0)).cast("long"))
    return chosen.select("row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _first_past(bins: DataFrame) -> DataFrame:
    """key, bin, before, n: the first bin of each key whose words, with those before it, reach what is needed, the words before it and its rows."""
    upto = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = bins.withColumn("end", F.col("before") + F.sum("words").over(upto)).where(F.col("end") >= F.col("need"))
    found = ends.groupBy("key").agg(F.min(F.struct("bin", (F.col("end") - F.col("words")).alias("before"), "n")).alias("f"))
    return found.select("key", "f.*")


def _ranked(rows: DataFrame, per: DataFrame, seed: str) -> DataFrame:
    """rows with their source's columns, the Pareto rank and its place, a whole number of PLACE bits that grows with it."""
    u = uniform(F.col("id"), seed)
    odds = F.col("share") / (1 - F.col("share")) * F.col("odds")
    rank = F.when(F.col("need") > 0, u / (1 - u) / odds).otherwise(F.lit(0.0))
    rows = rows.join(per, "key").withColumn("rank", rank)
    return rows.withColumn("place", F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * float(1 << PLACE)), F.lit((1 << PLACE) - 1)).cast("long"))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("row.doc_id", "size", "source_size", "target", "taken")


ORACLE = {
    "op5_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight,
         source_size * 2.0::DOUBLE AS most
  FROM per
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER before, 0.0::DOUBLE))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0::DOUBLE)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
         CASE WHEN level * weight >= most THEN most
              ELSE max(CASE WHEN level * weight < most THEN level END) OVER () * weight END AS target
  FROM levels
), needs AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets
), shares AS (
  SELECT *, target - whole * source_size AS need,
         CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0.0::DOUBLE END AS share
  FROM needs
), ranked AS (
  SELECT doc_id, size, source_size, target, whole, need, share,
         sum(size) OVER (PARTITION BY s.source ORDER BY CASE WHEN share > 0 THEN u / (1 - u) / (share / (1 - share) * sqrt(greatest(size, 1))) ELSE 0.0::DOUBLE END, doc_id, size
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0::DOUBLE AS middle
  FROM sized s JOIN shares p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN size > 0 THEN (whole + CASE WHEN share > 0 AND middle <= need THEN 1 ELSE 0 END) * size ELSE 0 END AS taken
FROM ranked
"""
}
