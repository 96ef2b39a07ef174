"""Safe arithmetic and the distribution functions Spark lacks, as Column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rational approximation of the normal distribution function (Hart 1968, West 2005).
CDF_NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
CDF_DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)

# Normal quantile, algorithm AS 241 (Wichura 1988), highest power first.
QUANTILE_CENTRE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4,
     4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3,
     1.3314166789178437745e2, 3.3871328727963666080e0),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4,
     2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2,
     4.2313330701600911252e1, 1.0),
)
QUANTILE_MIDDLE = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
     1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0,
     4.63033784615654529590e0, 1.42343711074968357734e0),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
     1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0,
     2.05319162663775882187e0, 1.0),
)
QUANTILE_TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
     2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0,
     5.46378491116411436990e0, 6.65790464350110377720e0),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
     7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
     5.99832206555887937690e-1, 1.0),
)


def polynomial(coefficients, x: Column) -> Column:
    """Horner evaluation, highest power first."""
    result = F.lit(coefficients[0])
    for c in coefficients[1:]:
        result = result * x + F.lit(c)
    return result


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that is null, not an error, where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def safe_ln(column: Column) -> Column:
    return F.ln(F.when(column > 0, column))


def safe_log10(column: Column) -> Column:
    return F.log10(F.when(column > 0, column))


def round_half_even(column: Column, digits: int = 0) -> Column:
    return F.bround(column, digits)


def norm_cdf(z: Column) -> Column:
    """Standard normal distribution function."""
    a = F.abs(z)
    density = F.exp(-a * a / 2)
    near = density * polynomial(CDF_NUMERATOR, a) / polynomial(CDF_DENOMINATOR, a)
    fraction = a + F.lit(0.65)
    for step in (4, 3, 2, 1):
        fraction = a + F.lit(float(step)) / fraction
    far = density / fraction / F.lit(math.sqrt(2 * math.pi))
    tail = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def norm_quantile(p: Column) -> Column:
    """Standard normal quantile; null outside (0, 1)."""
    q = p - F.lit(0.5)
    centre = F.lit(0.180625) - q * q
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))

    def fit(tables, x):
        return polynomial(tables[0], x) / polynomial(tables[1], x)

    outer = F.when(r <= 5, fit(QUANTILE_MIDDLE, r - F.lit(1.6))).otherwise(
        fit(QUANTILE_TAIL, r - F.lit(5.0)))
    value = F.when(F.abs(q) <= 0.425, q * fit(QUANTILE_CENTRE, centre)).otherwise(
        F.when(q < 0, -outer).otherwise(outer))
    return F.when((p > 0) & (p < 1), value)


def lognorm_quantile(p: Column) -> Column:
    return F.exp(norm_quantile(p))


#: Degrees of freedom beyond which the expansion around the normal quantile is exact to the last digits.
MANY = 1000
#: Newton steps to the quantile; they close in from below, the digits doubling with each.
NEWTON = 9


def t_quantile(level: float, df: Column) -> Column:
    """Two-sided Student quantile for confidence ``level`` and whole degrees of freedom from 1.

    With t = sqrt(n) tan(u) the probability inside (-t, t) is the finite form of the incomplete beta
    function for whole n, a sum of n / 2 powers of cos(u)**2, and its derivative is a power of cos(u); so
    u is found by Newton steps. Beyond ``MANY`` degrees the expansion in 1 / n is used.
    """
    z = NormalDist().inv_cdf((1 + level) / 2)
    n = df.cast("long")
    odd, terms = n % 2, F.floor(n / 2)
    steps = lambda last: F.when(last >= 1, F.sequence(F.lit(1).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))
    # derivative at 0: 2 / pi or 1, times (k - 1) / (k - 2) for k = n, n - 2, ... above 2
    top = F.aggregate(steps(F.floor((n - 1) / 2)), F.when(odd == 1, F.lit(2 / math.pi)).otherwise(F.lit(1.0)),
                      lambda c, k: c * (2 * k + 1 - odd) / (2 * k - odd))

    def inside(u: Column) -> Column:
        square = F.cos(u) * F.cos(u)
        start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

        def add(x: Column, j: Column) -> Column:
            term = x["term"] * (2 * j - 1 + odd) / (2 * j + odd) * square
            return F.struct(term.alias("term"), (x["sum"] + term).alias("sum"))

        total = F.when(terms >= 1, F.aggregate(steps(terms - 1), start, add)["sum"]).otherwise(F.lit(0.0))
        return F.when(odd == 1, 2 / math.pi * (u + F.sin(u) * F.cos(u) * total)).otherwise(F.sin(u) * total)

    angle = F.aggregate(F.array(*[F.lit(i) for i in range(NEWTON)]), F.atan(z / F.sqrt(n)),
                        lambda u, _: u + (level - inside(u)) / (top * F.pow(F.cos(u), n - 1)))
    g = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
         (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    far = F.lit(z) + polynomial((*reversed(g), 0.0), 1 / n)
    return F.when(n > MANY, far).when(n >= 1, F.sqrt(n) * F.tan(angle))


#: Grid values that one row is exploded to at once.
GRID_BLOCK = 4096


def numeric_grid(df: DataFrame, low: Column, high: Column, by: float, name: str) -> DataFrame:
    """One row per grid value low, low+by, ... not beyond high.

    Blocks are made first, dealt out, and exploded to their values, so neither a row nor a task ever
    holds a long range.
    """
    steps = F.floor((high - low) / by + F.lit(1e-10)).cast("long")
    blocks = df.withColumn("_last", steps).withColumn("_start", F.explode(F.when(
        F.col("_last") >= 0, F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / GRID_BLOCK)))))
    first = F.col("_start") * GRID_BLOCK
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (blocks.repartition(tasks).withColumn("_step", F.explode(F.sequence(first, F.least(first + GRID_BLOCK - 1, F.col("_last")))))
            .withColumn(name, low + F.col("_step") * F.lit(by)).drop("_step", "_start", "_last"))
