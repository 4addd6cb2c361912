"""The functions under names for SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from phonoscope.functions import ipa_reader, notation, plain, prosody, simplify

#: Names for selectExpr-like use on a DataFrame: each is a function of one column.
FUNCTIONS = {
    "tokens": notation.tokens,
    "readable": notation.readable,
    "readable_tokens": notation.readable_tokens,
    "machine": notation.machine,
    "machine_tokens": notation.machine_tokens,
    "notation_to_ipa": notation.notation_to_ipa,
    "notation_to_xsampa": notation.notation_to_xsampa,
    "ipa_to_xsampa": notation.ipa_to_xsampa,
    "xsampa_to_ipa": notation.xsampa_to_ipa,
    "ipa_to_notation": ipa_reader.ipa_to_notation,
    "simplify": simplify.simplify,
    "marks": prosody.marks,
    "syllables": prosody.syllables,
    "syllable_count": prosody.syllable_count,
}


class SyllableRows:
    """pos, syllable: a row for each syllable of a text."""

    def eval(self, text: str):
        for pos, syllable in enumerate(prosody._syllabified(text) or ()) if text is not None else ():
            yield pos, syllable


def register(spark: SparkSession) -> None:
    """Register the functions for SQL.

    Scalar functions of one string: the names in `plain.SCALARS`, `syllables`, `marks` and `ipa_to_notation`. Table functions for LATERAL
    joins: `syllable_rows(text)` and `simplified_rows(text)`. In SQL all run as Arrow functions; on DataFrames
    `with_functions` and the modules' own functions give expressions where there are any.
    """
    for name, (function, schema) in plain.SCALARS.items():
        spark.udf.register(name, plain.arrow_function(function, schema))
    spark.udf.register("syllables", F.pandas_udf(prosody._syllables_of, "array<string>"))
    spark.udf.register("marks", F.pandas_udf(prosody._marks_of, prosody.MARK_TYPE))
    spark.udf.register("ipa_to_notation", ipa_reader.scalar_udf())
    spark.udtf.register("syllable_rows", udtf(SyllableRows, returnType="pos int, syllable string"))
    spark.udtf.register("simplified_rows", udtf(plain.SimplifiedRows, returnType="place int, text string, code string, mass double, load map<string, string>"))


def with_functions(df: DataFrame, column: str, *names: str) -> DataFrame:
    """df with a column for each named function of `column`, named after both."""
    made: dict[str, Column] = {f"{column}_{n}": FUNCTIONS[n](F.col(column)) for n in names}
    return df.withColumns(made)
