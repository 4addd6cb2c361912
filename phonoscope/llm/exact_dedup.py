"""Exact dedup by distributed most-significant-digit radix partitioning.

Documents are split by successive digits of their bytes until a group holds one document or its bytes have
ended; what is still together is equal, so no digest decides anything.  The first digit is the byte length and
the leading bytes.  Groups of one leave at once, and only the rest, written as a table, sees later digits,
whose widths grow geometrically.  A later pass first compares the least and greatest digit of each group, both
combined before the shuffle: a group of copies, however large, moves no rows at all.  Only groups that do
differ are dealt anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoscope.llm.common import materialize, row_of, small, text_of

#: Leading bytes of the first digit, and by how much each later digit is wider.
FIRST_DIGIT, GROWTH = 64, 8


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: row (struct of all input columns), keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are; a null text counts as empty.  The row with the largest id stays;
    null ids come last, and of rows repeated with that id exactly one is kept.  An empty table gives an
    empty result.  Input columns may have any names: they stay inside `row`.
    """
    text = text_of(text_col)
    keyed = docs.select(
        row_of(docs).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        text.alias("text"),
        F.octet_length(text).alias("n"),
        F.substring(text.cast("binary"), 1, FIRST_DIGIT).alias("digit"),
    )
    shared = keyed.groupBy("n", "digit").agg(F.count("*").alias("size")).where("size > 1")
    shared = small(materialize(shared.select("n", "digit")), FIRST_DIGIT + 32)

    alone = keyed.join(shared, ["n", "digit"], "left_anti").select(
        "row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.sha2("text", 256).alias("text_sha256")
    )
    first = keyed.join(shared, ["n", "digit"]).withColumn("rid", F.monotonically_increasing_id())
    first = materialize(first.drop("digit"))
    names = first.select("rid", F.substring(F.col("text").cast("binary"), 1, FIRST_DIGIT).alias("digit"), "n")
    leads = names.groupBy("n", "digit").agg(F.min("rid").alias("gid"))
    alive = _joined(first.withColumn("digit", F.substring(F.col("text").cast("binary"), 1, FIRST_DIGIT)), leads, ["n", "digit"])
    alive = materialize(alive.select("rid", "gid", "id", "n", "text"))

    alive = _refined(alive)
    groups = alive.groupBy("gid").agg(F.count("*").alias("size"), F.max(F.struct(F.col("id").isNotNull().alias("has"), "id", "rid")).alias("top"))
    member = _joined(alive.select("rid", "gid"), groups, ["gid"]).select("rid", "size", F.col("top.id").alias("top_id"), F.col("top.rid").alias("top_rid"))
    found = first.select("rid", "row", "id", F.sha2("text", 256).alias("text_sha256")).join(member, "rid", "left")
    size = F.coalesce("size", F.lit(1).cast("long"))
    found = found.select(
        "row",
        F.when(size > 1, F.col("top_id")).otherwise(F.col("id")).alias("keep_id"),
        size.alias("group_size"),
        F.coalesce(F.col("rid") == F.col("top_rid"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
    return alone.unionByName(found)


def _joined(rows: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the summary of their group.

    The summary is written first: a small one is then broadcast, and beside a large one both sides are plain
    exchanges, whose hot partitions the adaptive join splits.
    """
    return rows.join(small(materialize(summary), 256), keys)


def _refined(alive: DataFrame) -> DataFrame:
    """Split the groups gid by digit after digit until every group has ended; groups of one leave."""
    done, width = FIRST_DIGIT, FIRST_DIGIT * GROWTH
    longest = alive.agg(F.max("n")).first()[0] or 0
    while done < longest:
        digit = F.substring(F.col("text").cast("binary"), done + 1, width)
        cut = alive.where(F.col("n") > done).withColumn("digit", digit)
        mixed = cut.groupBy("gid").agg(F.min("digit").alias("least"), F.max("digit").alias("most")).where("least <> most").select("gid")
        mixed = materialize(mixed)
        if not mixed.isEmpty():
            mixed = small(mixed, 16)
            split = materialize(cut.join(mixed, "gid"))
            parts = split.groupBy("gid", "digit").agg(F.min("rid").alias("next"), F.count("*").alias("size"))
            split = split.join(materialize(parts), ["gid", "digit"]).where("size > 1")
            split = split.select("rid", F.col("next").alias("gid"), "id", "n", "text")
            alive = materialize(alive.join(mixed, "gid", "left_anti").select("rid", "gid", "id", "n", "text").unionByName(split))
        done, width = done + width, width * GROWTH
    return alive


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts; columns unchanged."""
    return exact_groups(docs, id_col, text_col).where("kept").select("row.*")


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_groups(docs).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = {
    "op10_exact_dedup": """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
}
