"""Ranked simplification as a relational plan: expand, transform, group, normalise.

The 64 levels of a text share prefixes of their rewrites, so rows are expanded feature by feature and each
rewrite runs once for each prefix.  The greatest weight of each text is found by an aggregate that combines
before the shuffle; both the grouping by text and the range of weights need the rows of one input together, so
one exchange by row id serves both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phonoscope.functions import simplify as S
from phonoscope.functions.notation import machine

#: Levels of a text.
LEVELS = 64


def expanded(df: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """id columns, text, raw, ordinal: one row for each level of each input row."""
    rows = df.select(*id_cols, S.without_escapes(F.col(text_col)).alias("text"), F.lit(1).cast("long").alias("raw"), F.lit(0).alias("ordinal"))
    for feature in S.ORDER:
        rows = rows.select(*id_cols, F.inline(S.variants(F.col("text"), F.col("raw"), F.col("ordinal"), feature)))
    return rows


def ranked_views(df: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """id columns, text, code, raw_mass, mass, load, place: each simplified text of a row once, place 1 the heaviest.

    id_cols name a row; null texts and texts that simplify to nothing give no rows.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    levels = expanded(df.where(F.col(text_col).isNotNull()).repartition(tasks, *id_cols), id_cols, text_col)
    # A weight and a level's number in one long: the greatest weight, and of levels that have it the first.
    best = F.max(F.col("raw") * LEVELS + (LEVELS - 1 - F.col("ordinal"))).alias("best")
    views = levels.groupBy(*id_cols, "text").agg(best, F.min("ordinal").alias("seen")).where("text <> ''")
    late = F.pmod("best", F.lit(LEVELS))
    views = views.select(*id_cols, "text", "seen", F.expr(f"best div {LEVELS}").alias("raw_mass"), (F.lit(LEVELS - 1) - late).cast("int").alias("ordinal"))
    row = Window.partitionBy(*id_cols)
    mass = S.normalized_mass(F.col("raw_mass"), F.min("raw_mass").over(row), F.max("raw_mass").over(row))
    place = F.row_number().over(row.orderBy(F.desc("raw_mass"), "seen"))
    return views.select(*id_cols, "text", machine(F.col("text")).alias("code"), "raw_mass", mass.alias("mass"), S.load(F.col("ordinal")).alias("load"), place.alias("place"))
