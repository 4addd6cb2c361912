"""Lookup by simplified key, and likeness of rhymes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoscope.functions.rhyme_table import WEIGHTS
from phonoscope.plans.ranked import ranked_views


def phonetic_keys(words: DataFrame, word_col: str = "word", min_mass: float = 0.0) -> DataFrame:
    """word, text, mass: the keys under which each distinct word can be found."""
    distinct = words.select(F.col(word_col).alias("word")).where("word is not null").distinct()
    return ranked_views(distinct, ["word"], "word").where(F.col("mass") >= min_mass).select("word", "text", "mass")


def phonetic_lookup(words: DataFrame, dictionary: DataFrame, word_col: str = "word", min_mass: float = 0.0) -> DataFrame:
    """word, entry, score: entries that share a key with a word; the score is the best over keys of the lesser mass.

    Short keys are shared by many words and join them all; min_mass keeps keys of little weight out of the join, on both
    sides and before it.  The join is on the key alone, so Catalyst picks its strategy and splits hot keys.
    """
    left = phonetic_keys(words, word_col, min_mass)
    right = phonetic_keys(dictionary, word_col, min_mass).withColumnsRenamed({"word": "entry", "mass": "entry_mass"})
    return left.join(right, "text").groupBy("word", "entry").agg(F.max(F.least("mass", "entry_mass")).alias("score"))


def rhyme_table(spark) -> DataFrame:
    """a, b, weight: likeness of consonants in a rhyme; 140 rows."""
    return spark.createDataFrame(WEIGHTS, "a string, b string, weight double")


def rhyme_score(a: Column, b: Column) -> Column:
    """Mean likeness of two strings' consonants place by place, 0 where the table has none; an extension.

    The longer string's further consonants count as unlike; without consonants on either side the score is null.
    """
    table = F.create_map(*[x for p, q, w in WEIGHTS for x in (F.lit(p + q), F.lit(w))])
    sounds = lambda c: F.regexp_extract_all(c, F.lit("[mnNgbptdkslrhfvwz]"), F.lit(0))
    pairs = F.zip_with(sounds(a), sounds(b), lambda x, y: F.coalesce(table[F.concat(x, y)], F.lit(0.0)))
    return F.when(F.size(pairs) > 0, F.aggregate(pairs, F.lit(0.0), lambda s, w: s + w) / F.size(pairs))
