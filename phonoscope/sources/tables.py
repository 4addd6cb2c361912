"""Tables to work on: words of text columns, and the notation's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoscope.functions import glyphs
from phonoscope.functions.notation import machine_token, readable_token
from phonoscope.functions.simplify import CHOICES, choice_of
from phonoscope.functions.xsampa_table import PAIRS


#: A table of fewer bytes for each core than this is dealt over all cores.
SPREAD = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df as read, but a small table's rows dealt over all cores: a file of one row group is one task however many cores there are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < SPREAD * cores else df


def words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """word: the distinct runs of a-z in a text column, in lower case; all of them can be read as notation.

    Words repeat a great deal, so costly functions are best applied to these and joined back to their texts.
    """
    parts = F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z]+"), F.lit(0)))
    # The words are few beside their texts, so a wide number of tasks for what follows costs little.
    cores = df.sparkSession.sparkContext.defaultParallelism
    return spread(df).select(parts.alias("word")).distinct().repartition(max(cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "word")


def glyph_table(spark: SparkSession) -> DataFrame:
    """key, readable, machine: all glyphs, the vowels made from the choices of their marks."""
    vowel = spark.createDataFrame([(c,) for c in glyphs.VOWEL_LETTERS], "key string")
    for choices in ((glyphs.VARIANT,), (glyphs.NASAL,), (glyphs.SYLLABIC,), glyphs.TONES, glyphs.LENGTHS, (glyphs.ACCENT,)):
        mark = F.explode(F.array(F.lit(""), *[F.lit(c) for c in choices]))
        vowel = vowel.select("key", mark.alias("mark")).select(F.concat("key", "mark").alias("key"))
    others = spark.createDataFrame([(k,) for k in glyphs.READABLE], "key string")
    keys = vowel.unionByName(others)
    return keys.select("key", readable_token(F.col("key")).alias("readable"), machine_token(F.col("key")).alias("machine"))


def xsampa_table(spark: SparkSession) -> DataFrame:
    """place, xsampa, ipa: the 181 rows of the table."""
    return spark.createDataFrame([(k, x, i) for k, (x, i) in enumerate(PAIRS)], "place int, xsampa string, ipa string")


def simplify_levels(spark: SparkSession) -> DataFrame:
    """ordinal and the choice of each feature: the 64 levels."""
    return spark.range(64).select(F.col("id").cast("int").alias("ordinal"), *[choice_of(F.col("id"), f).alias(f) for f in CHOICES])
