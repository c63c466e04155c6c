"""Percentiles of very large numeric columns by radix selection.

A number is mapped to an integer of the same order (the bits of its double,
negative numbers inverted). The bits are read digit by digit: a histogram of
the first digit over all values of a group tells in which digit each target
rank lies, the next histogram is made of the values in these digits only, and
so on. Histograms are plain counts, so those of separate partitions or days
add up, and the answer does not depend on how the rows were split.

Error: after ``b`` bits in all the answer is the lower end of a bucket whose
width is below 2**(12 - b) of the value (12 bits are sign and exponent).
The default digits, 16 + 8 + 8 bits, give a relative error below 1e-6, and the
exact value for whole numbers below 2**21 in size. 64 bits are always exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.session import cut

DIGITS = (16, 8, 8)
_TOP = -(2**63)


def ordered_key(value: Column) -> Column:
    """A signed 64-bit integer in the order of the double ``value`` (-0.0 counts as 0.0)."""
    bits = double_bits(value)
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF))).otherwise(bits)


def double_bits(value: Column) -> Column:
    """The IEEE-754 bits of a double as a long, from arithmetic that stays exact."""
    v = value.cast("double") + F.lit(0.0)
    size = F.abs(v)
    guess = F.floor(F.log2(size)).cast("int")
    power = F.when(F.pow(F.lit(2.0), guess) > size, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1).otherwise(guess)
    power = F.greatest(power, F.lit(-1022))
    fraction = size / F.pow(F.lit(2.0), power)
    mantissa = ((fraction - F.when(fraction >= 1, F.lit(1.0)).otherwise(F.lit(0.0))) * F.lit(float(2**52))).cast("long")
    exponent = F.when(fraction >= 1, power + 1023).otherwise(F.lit(0)).cast("long")
    magnitude = F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(0x7FF0000000000000)).otherwise(F.shiftleft(exponent, 52) + mantissa)
    return F.when(v < 0, magnitude.bitwiseOR(F.lit(_TOP))).otherwise(magnitude)


def key_value(key: Column) -> Column:
    """The double whose ordered key is ``key``."""
    bits = F.when(key < 0, key.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF))).otherwise(key).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
    exponent = F.shiftright(bits, 52).cast("int")
    mantissa = bits.bitwiseAND(F.lit(2**52 - 1)).cast("double") / F.lit(float(2**52))
    size = F.when(exponent == 0, mantissa * F.pow(F.lit(2.0), F.lit(-1022))).when(exponent == 2047, F.lit(float("inf"))).otherwise((mantissa + 1) * F.pow(F.lit(2.0), exponent - 1023))
    return F.when(key < 0, -size).otherwise(size)


def counted(df: DataFrame, groups: Sequence[str], parts: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mergeable state: rows (groups, parts, metric, key, n), pre-aggregated before the one shuffle.

    Null and NaN values are left out; a null group is a group of its own; an
    empty table gives an empty state. Columns of ``df`` not named are ignored.
    """
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("__x")
    flat = df.select(*groups, *parts, values).select(*groups, *parts, "__x.metric", "__x.v").where("v is not null and not isnan(v)")
    return flat.groupBy(*groups, *parts, "metric", "v").agg(F.count("*").alias("n")).select(*groups, *parts, "metric", ordered_key(F.col("v")).alias("key"), "n")


def first_histogram(state: DataFrame, by: Sequence[str], bits: int = DIGITS[0]) -> DataFrame:
    """The histogram of the first digit, by any columns of the state (a day, a group, or both)."""
    return state.groupBy(*by, "metric", F.shiftright(F.col("key"), 64 - bits).alias("digit")).agg(F.sum("n").alias("n"))


def select_ranks(state: DataFrame, groups: Sequence[str], probabilities: Sequence[float], digits: Sequence[int] = DIGITS) -> DataFrame:
    """Rows (groups, metric, p, n, value): the value of rank ceil(p * n) of each group.

    ``state`` comes from :func:`counted`, or is a union of several such states.
    Each level makes a histogram of one digit, at most 2**bits cells for each
    group and prefix followed; a hot group is summed map-side, so no task holds
    its rows. The state is read once a level. Targets and cells grow with the groups: neither is broadcast.
    """
    if sum(digits) > 64 or min(digits) < 1:
        raise ValueError("digits must be positive and sum to at most 64 bits")
    by = [*groups, "metric"]
    total = state.groupBy(*by).agg(F.sum("n").alias("n"))
    ranks = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("n"))).cast("long").alias("rank")) for p in probabilities])
    targets = total.select(*by, F.col("n").alias("total"), F.explode(ranks).alias("t")).select(*by, "total", "t.p", "t.rank", F.lit(0).cast("long").alias("prefix"))
    rest, used = state.withColumn("prefix", F.lit(0).cast("long")), 0
    for level, bits in enumerate(digits):
        used += bits
        cells = rest.groupBy(*by, "prefix", F.shiftright(F.col("key"), 64 - used).alias("digit")).agg(F.sum("n").alias("n"))
        upto = Window.partitionBy(*by, "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cells = cells.withColumn("upto", F.sum("n").over(upto))
        inside = (F.col("t.rank") <= F.col("c.upto")) & (F.col("t.rank") > F.col("c.upto") - F.col("c.n"))
        hit = targets.alias("t").join(cells.alias("c").hint("merge"), _same("t", "c", [*by, "prefix"]) & inside)
        below = F.col("c.upto") - F.col("c.n")
        targets = cut(hit.select(*[F.col(f"t.{c}").alias(c) for c in by], "t.total", "t.p", (F.col("t.rank") - below).alias("rank"), F.col("c.digit").alias("prefix")))
        if level + 1 < len(digits):
            followed = targets.select(*by, "prefix").distinct()
            here = state.withColumn("prefix", F.shiftright(F.col("key"), 64 - used))
            rest = here.alias("r").join(followed.alias("f").hint("merge"), _same("r", "f", [*by, "prefix"]), "left_semi")
    left = 64 - used
    low = F.shiftleft(F.col("prefix"), left)
    key = F.when(low < 0, low + F.lit((1 << left) - 1)).otherwise(low) if left else low
    return targets.select(*by, "p", F.col("total").alias("n"), key_value(key).alias("value"))


def _same(a: str, b: str, columns: Sequence[str]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return condition
