"""Chi-square and Student-t probabilities as column expressions: nothing leaves the JVM.

Continued fractions and series are folds over a sequence, a few dozen steps a row. They are meant for
results of a row a series; specfun has the same functions for numpy.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col, dbl

#: Steps of the series and of the fraction for erfc, which meet at BETWEEN.
SERIES, FRACTION, BETWEEN = 60, 80, 2.0
#: Newton steps towards a quantile; from the median they approach it from one side.
NEWTON = 40


def _steps(n: int) -> Column:
    return F.sequence(F.lit(1), F.lit(n))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once a row: a fold's lambda computes what it names anew at each step."""
    return F.element_at(F.transform(F.array(value), body), 1)


def erfc(z: Column | str) -> Column:
    """The complementary error function of z >= 0."""
    def of(z):
        # erf(z) = 2 / sqrt(pi) * exp(-z^2) * (z + z * (2 z^2) / 3 + z * (2 z^2)^2 / (3 * 5) + ...); a term is added the step after it is made
        add = lambda s, k: F.struct((s["term"] * s["twice"] / (2 * k + 1)).alias("term"), (s["total"] + s["term"]).alias("total"), s["twice"].alias("twice"))
        series = F.aggregate(_steps(SERIES), F.struct(z.alias("term"), dbl(0).alias("total"), (2 * z * z).alias("twice")), add, lambda s: s["total"] + s["term"])
        # erfc(z) = exp(-z^2) / sqrt(pi) / (z + (1/2) / (z + (2/2) / (z + (3/2) / ...))), from the far end
        fraction = F.aggregate(F.sequence(F.lit(FRACTION), F.lit(1), F.lit(-1)), z, lambda f, k: z + k / dbl(2) / f)
        return F.when(z < BETWEEN, 1 - dbl(2 / math.sqrt(math.pi)) * F.exp(-z * z) * series).otherwise(F.exp(-z * z) / dbl(math.sqrt(math.pi)) / fraction)

    return _let(col(z).cast("double"), of)


def chi2_tail_1(x: Column | str) -> Column:
    """Survival function of chi-square with one degree of freedom; NULL for missing."""
    return erfc(F.sqrt(F.greatest(F.when(col(x).isNotNull(), dbl(0)), col(x)) / 2))


def ln_gamma(x: Column) -> Column:
    """Of x > 0: Stirling's series at x + 10, less the factors in between."""
    y = x + 10
    series = (y - 0.5) * F.ln(y) - y + dbl(0.5 * math.log(2 * math.pi)) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, dbl(5))) - 1 / (1680 * F.pow(y, dbl(7))) + 1 / (1188 * F.pow(y, dbl(9)))
    between = x
    for k in range(1, 10):
        between = between * (x + k)
    return series - F.ln(between)


def _fraction(a: Column, b: Column, x: Column, steps: Column) -> Column:
    """The continued fraction of the incomplete beta function, two of its terms a step (Lentz)."""

    def of(at):
        a, b, x = at["a"], at["b"], at["x"]

        def numerator(k):
            m = F.floor(k / 2)
            return F.when(k % 2 == 0, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))).otherwise(-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))

        # The product takes in the c and d of a term at the next one, so that they are computed once.
        def step(s, n):
            return F.struct((1 + n / s["c"]).alias("c"), (1 / (1 + n * s["d"])).alias("d"), (s["out"] * s["c"] * s["d"]).alias("out"))

        first = 1 / (1 - (a + b) * x / (a + 1))
        numerators = F.transform(F.sequence(F.lit(2), 2 * at["steps"] + 1), numerator)
        return F.aggregate(numerators, F.struct(dbl(1).alias("c"), first.alias("d"), dbl(1).alias("out")), step, lambda s: s["out"] * s["c"] * s["d"])

    return _let(F.struct(a.alias("a"), b.alias("b"), x.alias("x"), steps.alias("steps")), of)


def _beta_tail(v: Column, share: Column) -> Column:
    """The regularised incomplete beta function I(v / 2, 1 / 2) at `share`, in (0, 1)."""
    a, b = v / 2, dbl(0.5)
    front = F.exp(ln_gamma(a + 0.5) - ln_gamma(a) - dbl(0.5 * math.log(math.pi)) + a * F.ln(share) + 0.5 * F.log1p(-share))
    steps = F.ceil(40 + 2 * F.sqrt(v)).cast("int")
    return F.when(share < (a + 1) / (a + 2.5), front * _fraction(a, b, share, steps) / a).otherwise(1 - front * _fraction(b, a, 1 - share, steps) / b)


def t_two_sided(t: Column | str, v: Column | str) -> Column:
    """The two-sided p-value of a Student-t statistic with v degrees of freedom; NULL for missing, or no degree."""
    t, v = col(t).cast("double"), col(v).cast("double")
    def of(at):
        v, share = at["v"], at["share"]
        return F.when(share >= 1, dbl(1)).when(share <= 0, dbl(0)).otherwise(_beta_tail(v, share))

    return F.when(v > 0, F.when(t == 0, dbl(1)).otherwise(_let(F.struct(v.alias("v"), (v / (v + t * t)).alias("share")), of)))


def t_density(x: Column | str, v: Column | str) -> Column:
    x, v = col(x), col(v)
    return F.exp(ln_gamma((v + 1) / 2) - ln_gamma(v / 2) - 0.5 * F.ln(v * math.pi) - (v + 1) / 2 * F.log1p(x * x / v))


def t_quantile(p: Column | str, v: Column | str) -> Column:
    """Of p in (0, 1). In the lower half the distribution function is convex, so Newton steps from the
    median never overshoot; the upper half follows by symmetry."""
    p, v = col(p).cast("double"), col(v).cast("double")
    low = F.least(p, 1 - p)
    step = lambda x, _: x - (t_two_sided(x, v) / 2 - low) / t_density(x, v)
    x = F.aggregate(_steps(NEWTON), dbl(0), step)
    return F.when((p > 0) & (p < 1) & (v > 0), F.when(p < 0.5, x).when(p > 0.5, -x).otherwise(dbl(0)))
