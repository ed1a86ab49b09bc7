"""Word error rate and helpers: words become letters of one alphabet per pair, whose distance the engine knows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

#: the letters that words become: code units without surrogates, so many different words a pair may have
FIRST_LETTER, LETTERS = 0x3400, 0xD800 - 0x3400


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9; other scripts have none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def word_errors(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


@pandas_udf(IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0 if x is None else word_errors(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def lettered(words: str, known: str) -> Column:
    """An array of words as a string with one letter each, by their places in ``known``."""
    units = F.transform(words, lambda w: F.lpad(F.hex(F.array_position(known, w) + (FIRST_LETTER - 1)), 4, "0"))
    return F.decode(F.unhex(F.array_join(units, "")), "UTF-16BE")


def with_wer(df: DataFrame, reference: str, hypothesis: str, name: str = "wer") -> DataFrame:
    """df with the word error rate of two text columns, by functions of the engine alone.

    Word edits over the reference's words; without any, 0 if the other has none
    either, else 1. Pairs of more than ``LETTERS`` different words go word by word.
    """
    split = df.withColumns({"_a": tokens(F.col(reference)), "_b": tokens(F.col(hypothesis))}).withColumn("_known", F.array_union("_a", "_b"))
    letters = F.levenshtein(lettered("_a", "_known"), lettered("_b", "_known"))
    many = F.size("_known") > LETTERS
    # batches are made of all rows, so the others go into them empty
    edits = F.when(many, _distance(F.when(many, F.col("_a")), F.col("_b"))).otherwise(letters)
    return split.withColumn(name, F.when(F.size("_a") > 0, edits / F.size("_a")).otherwise(F.when(F.size("_b") > 0, 1.0).otherwise(0.0))).drop("_a", "_b", "_known")


def wer(reference: Column, hypothesis: Column) -> Column:
    """The same as one Column, word by word in batches."""
    a, b = tokens(reference), tokens(hypothesis)
    return F.when(F.size(a) > 0, _distance(a, b) / F.size(a)).otherwise(F.when(F.size(b) > 0, 1.0).otherwise(0.0))
