"""Which strings lie within any of others, as equi-joins on grams: no nested loop, whatever both sides' sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of the grams that the longer strings are indexed by; a shorter string is looked up by the largest that fits.
SIZES = (1, 2, 4, 8, 16)
#: Places of a string whose grams are considered, evenly spread; the rarest is looked up.
PLACES = 4


def _gram_size(c: Column) -> Column:
    out = F.lit(SIZES[0])
    for n in SIZES[1:]:
        out = F.when(F.length(c) >= n, n).otherwise(out)
    return out


def gram_index(within: DataFrame, c: str) -> DataFrame:
    """``gram``, ``within``: every gram of the sizes of each distinct string."""
    own = within.select(F.col(c).alias("within")).where("within <> ''").distinct()
    each = own.select("within", F.explode(F.array(*[F.lit(n) for n in SIZES])).alias("n")).where(F.length("within") >= F.col("n"))
    last = F.length("within") - F.col("n") + 1
    return each.select("within", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring("within", i, F.col("n"))))).alias("gram"))


def _looked_up(needles: DataFrame, index: DataFrame) -> DataFrame:
    """``needle``, ``gram``: the rarest of some grams of each needle; needles with a gram that nothing has are gone."""
    n, last = _gram_size(F.col("needle")), F.length("needle") - _gram_size(F.col("needle"))
    spots = F.transform(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda k: F.floor(last * k / (PLACES - 1)).cast("int") + 1)
    grams = F.array_distinct(F.transform(spots, lambda i: F.substring("needle", i, n)))
    often = index.groupBy("gram").agg(F.count("*").alias("often"))
    asked = needles.select("needle", F.explode(grams).alias("gram")).join(often, "gram", "left")
    rarest = asked.groupBy("needle").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram")).alias("x"))
    return rarest.where("x.often > 0").select("needle", "x.gram")


def contained(needles: DataFrame, c: str, within: DataFrame, other: str) -> DataFrame:
    """The distinct strings of ``needles`` in column ``c`` that lie within any string of ``within`` in column ``other``.

    Exact: a needle's rarest gram is looked up in the index, and what has it is compared. Empty and null strings lie
    within nothing. A needle stops at the first string that holds it, so many that do cost no rows.
    """
    own = needles.select(F.col(c).alias("needle")).where("needle <> ''").distinct()
    index = gram_index(within, other)
    held = index.withColumnRenamed("gram", "held")
    found = _looked_up(own, index).join(held, (F.col("gram") == F.col("held")) & F.contains("within", "needle"), "left_semi")
    return found.select(F.col("needle").alias(c))


def pairs(needles: DataFrame, c: str, within: DataFrame, other: str) -> DataFrame:
    """``needle``, ``within``: all pairs of distinct strings of which the second holds the first."""
    own = needles.select(F.col(c).alias("needle")).where("needle <> ''").distinct()
    index = gram_index(within, other)
    return _looked_up(own, index).join(index, "gram").where(F.contains("within", "needle")).select("needle", "within")
