"""The rational pulse relations and their classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The eleven relations of one pulse to another.
RELATIONS = [
    ("quarter", 1, 4),
    ("one_third", 1, 3),
    ("half", 1, 2),
    ("two_thirds", 2, 3),
    ("three_quarters", 3, 4),
    ("equivalent", 1, 1),
    ("four_thirds", 4, 3),
    ("three_halves", 3, 2),
    ("double_time", 2, 1),
    ("triple", 3, 1),
    ("quadruple", 4, 1),
]
#: Relations that never make a production candidate alone.
EXTREME = ("quarter", "one_third", "triple", "quadruple")
#: The lowest and highest production rate.
RAIL = (40.0, 220.0)


def bit(name: str) -> int:
    return 1 << [r[0] for r in RELATIONS].index(name)


def mask(*names: str) -> int:
    return sum(bit(n) for n in names)


def has(bits: Column, *names: str) -> Column:
    return bits.bitwiseAND(F.lit(mask(*names)).cast("long")) != 0


def table(spark: SparkSession) -> DataFrame:
    """(name, num, den, ratio, bit): eleven rows, whatever the data."""
    rows = [(n, a, b, a / b, bit(n)) for n, a, b in RELATIONS]
    return spark.createDataFrame(rows, "name string, num int, den int, ratio double, bit long")


def expand(rate: Column, low: float = RAIL[0], high: float = RAIL[1]) -> Column:
    """An array of (relation, bit, rate) for all relations of a rate that stay inside the rail; no join is needed for eleven constants."""
    every = F.array(*[F.struct(F.lit(n).alias("relation"), F.lit(bit(n)).cast("long").alias("bit"), (rate * F.lit(a / b)).alias("rate")) for n, a, b in RELATIONS])
    return F.filter(every, lambda x: x["rate"].between(low, high))


def expanded(rows: DataFrame, rate: Column, low: float = RAIL[0], high: float = RAIL[1]) -> DataFrame:
    """rows with x (bit, rate), one for each relation of the rate that stays inside the rail; compiled, which expand() isn't."""
    every = F.array(*[F.struct(F.lit(bit(n)).cast("long").alias("bit"), (rate * F.lit(a / b)).alias("rate")) for n, a, b in RELATIONS])
    return rows.withColumn("x", F.explode(every)).where(F.col("x.rate").between(low, high))


def in_reach(rate: Column, low: float = RAIL[0], high: float = RAIL[1]) -> Column:
    """Whether any relation of the rate stays inside the rail, which is wider than any step from one relation to the next."""
    return (rate * 4.0 >= low) & (rate * 0.25 <= high)


def sql_values() -> str:
    """The same table as SQL."""
    return "(VALUES " + ", ".join(f"('{n}', {a / b!r}::DOUBLE, {bit(n)}::BIGINT)" for n, a, b in RELATIONS) + ") r(relation, ratio, bit)"


def matches(rate: Column, other: Column, ratio: float, tolerance: float) -> Column:
    """Whether rate / other is the ratio, by absolute error; false unless both are positive."""
    return F.when((rate > 0) & (other > 0), F.abs(rate / other - ratio) <= tolerance).otherwise(F.lit(False))
