"""Self-delimiting integer codes as bit strings, and bit utilities, as native expressions over positive integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits(x: Column) -> Column:
    return F.bin(x.cast("long"))


def width(x: Column) -> Column:
    return F.length(bits(x)).cast("long")


def ones(x: Column) -> Column:
    return F.bit_count(x).cast("long")


def elias_gamma(x: Column) -> Column:
    """As many zeros as the binary form has digits after the first, then the binary form."""
    return F.concat(F.repeat(F.lit("0"), F.length(bits(x)) - 1), bits(x))


def elias_delta(x: Column) -> Column:
    """The number of binary digits in gamma code, then the digits after the first."""
    return F.concat(elias_gamma(F.length(bits(x))), F.substr(bits(x), F.lit(2)))


def elias_gamma_value(code: Column) -> Column:
    """The integer of a gamma code."""
    zeros = F.length(F.regexp_extract(code, "^0*", 0))
    return F.conv(F.substr(code, zeros + 1), 2, 10).cast("long")


def fibonacci(x: Column, most: int = 60) -> Column:
    """Zeckendorf digits from the smallest up, and a final 1: greedy from the largest Fibonacci number down."""
    numbers = [1, 2]
    while len(numbers) < most:
        numbers.append(numbers[-1] + numbers[-2])
    start = F.struct(x.cast("long").alias("rest"), F.lit("").alias("code"))
    table = F.array(*[F.lit(n).cast("long") for n in reversed(numbers)])

    def step(s: Column, n: Column) -> Column:
        take = s["rest"] >= n
        digit = F.when(take, "1").when(s["code"] == "", "").otherwise("0")
        return F.struct(F.when(take, s["rest"] - n).otherwise(s["rest"]).alias("rest"), F.concat(digit, s["code"]).alias("code"))

    return F.concat(F.aggregate(table, start, step)["code"], F.lit("1"))


def comma(x: Column) -> Column:
    """Comma code with two bits a digit: digits to base 3, and 11 as the end."""
    digits = F.conv(x.cast("string"), 10, 3)
    return F.concat(F.array_join(F.transform(F.split(digits, ""), lambda d: F.when(d == "", "").otherwise(F.lpad(F.bin(d.cast("long")), 2, "0"))), ""), F.lit("11"))
