"""Column expressions for texts that stay in the JVM.

An array that a lambda reads must come from a projection of its own (the optimiser would evaluate an inlined array once an
element); rows are exploded by the outer variants, because for the others a filter is inferred that evaluates the array again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words between ASCII white space; words of letters and digits, non-ASCII characters included.
SPACES = "[\\x20\\x09-\\x0D]+"
NON_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_words(text: Column, between: str) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), between), "")


def rolling_hashes(df: DataFrame, words: str, size: int, out: str) -> DataFrame:
    """df with the hashes of every `size` consecutive words (none if there are fewer): by doubling, each step one pass."""
    keep = [c for c in df.columns if c != out]
    now = df.withColumn("_1", F.transform(words, lambda w: F.xxhash64(w)))
    have = 1
    while have < size:
        more = min(have, size - have)
        far = F.slice("_1", more + 1, F.greatest(F.size("_1") - more, F.lit(0)))
        now = now.select(*[c for c in keep if c in now.columns], F.zip_with("_1", far, lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))).alias("_1"))
        now = now.withColumn("_1", F.slice("_1", 1, F.greatest(F.size("_1") - more, F.lit(0))))
        have += more
    return now.withColumnRenamed("_1", out)
