"""Normal, chi-square and factorial expressions, for columns of any table."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def ln_factorial(n: Column) -> Column:
    """ln(n!) for n >= 0, from the Stirling series at n + 9 (about 1e-12 relative)."""
    x = n.cast("double")
    steps = F.lit(1.0)
    for i in range(1, 9):
        steps = steps * (x + i)
    z = x + 9.0
    series = 1.0 / (12.0 * z) - 1.0 / (360.0 * z * z * z) + 1.0 / (1260.0 * F.pow(z, F.lit(5.0))) - 1.0 / (1680.0 * F.pow(z, F.lit(7.0)))
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - F.ln(steps)


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0: power series below 2, continued fraction above."""
    square = x * x
    # erf(x) = 2/sqrt(pi) * exp(-x²) * sum_k 2^k x^(2k+1) / (2k+1)!!
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(45)),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda acc, k: F.struct((acc["t"] * 2.0 * square / (2.0 * k + 1.0)).alias("t"), (acc["s"] + acc["t"] * 2.0 * square / (2.0 * k + 1.0)).alias("s")),
    )
    low = 1.0 - 2.0 / math.sqrt(math.pi) * F.exp(-square) * x * terms["s"]
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x.cast("double"), lambda acc, k: x + (k / 2.0) / acc)
    high = F.exp(-square) / math.sqrt(math.pi) / fraction
    return F.when(x < 2.0, low).otherwise(high)


def normal_two_sided(z: Column) -> Column:
    """Two-sided p value of a normal deviate."""
    return erfc(F.abs(z) / math.sqrt(2.0))


def log10_normal_two_sided(z: Column) -> Column:
    """log10 of the two-sided p value, also where the p value itself would underflow."""
    x = F.abs(z) / math.sqrt(2.0)
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x.cast("double"), lambda acc, k: x + (k / 2.0) / acc)
    far = (-x * x - F.ln(fraction) - 0.5 * math.log(math.pi)) / math.log(10.0)
    return F.when(x < 2.0, F.log10(erfc(x))).otherwise(far)


def chi_square_sf(x: Column, dof: Column) -> Column:
    """Upper tail of the chi-square distribution with whole degrees of freedom, by its finite sums."""
    h, k = x / 2.0, dof.cast("int")
    last = F.when(k % 2 == 0, k / 2 - 1).otherwise((k - 1) / 2).cast("int")
    even = F.aggregate(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))), F.lit(0.0), lambda acc, i: acc + F.exp(i * F.ln(h) - h - ln_factorial(i)),
    )
    # Γ(i + 1/2) = (2i)! sqrt(pi) / (4^i i!)
    odd = F.aggregate(
        F.sequence(F.lit(1), F.greatest(last, F.lit(1))), F.lit(0.0),
        lambda acc, i: acc + F.exp((i - 0.5) * F.ln(h) - h - (ln_factorial(2 * i) + 0.5 * math.log(math.pi) - i * math.log(4.0) - ln_factorial(i))),
    )
    tail = F.when(k % 2 == 0, even).when(k == 1, erfc(F.sqrt(h))).otherwise(erfc(F.sqrt(h)) + odd)
    return F.when(x <= 0, 1.0).otherwise(F.least(tail, F.lit(1.0)))
