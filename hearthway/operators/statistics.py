"""Rank statistics, correlations, contingency and anomaly tests; sums in Spark, tails of distributions from one row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scores import average_rank, robust_z


def chi2_tail(x: float, df: int) -> float:
    """P(X >= x) of the chi-square distribution, by the series or the continued fraction of the incomplete gamma."""
    if x <= 0 or df <= 0:
        return 1.0
    a, z = df / 2, x / 2
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-15 * abs(total):
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - total * scale)
    b, c = z + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, scale * h)


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _series(terms: Column, ratio) -> Column:
    """1 + r(1) + r(1) r(2) + ... over ``terms`` ratios r(k)."""
    steps = F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * ratio(k)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    return F.aggregate(steps, start, add, lambda acc: acc["sum"])


def t_two_sided(t: Column, df: Column, most: int = 2000) -> Column:
    """P(|T| >= |t|) of Student's distribution with ``df`` degrees of freedom, by its finite series in the angle.

    Beyond ``most`` degrees the distribution with ``most`` stands for it.
    """
    n = F.least(df, F.lit(most)).cast("int")
    angle = F.atan(F.abs(t) / F.sqrt(n))
    c = F.pow(F.cos(angle), 2)
    even = F.sin(angle) * _series(F.floor(n / 2).cast("int") - 1, lambda k: c * (2 * k - 1) / (2 * k))
    rest = F.when(n > 1, F.sin(angle) * F.cos(angle) * _series(F.floor((n - 3) / 2).cast("int"), lambda k: c * (2 * k) / (2 * k + 1))).otherwise(F.lit(0.0))
    odd = (angle + rest) * 2 / math.pi
    return F.greatest(F.lit(0.0), 1 - F.when(n % 2 == 0, even).otherwise(odd))


def normal_upper(z: Column) -> Column:
    """P(Z >= z) of the normal distribution, by a series of positive terms; beyond 6 deviations it counts as 0 or 1."""
    x = F.abs(z)
    half = x * F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * _series(F.lit(120), lambda k: x * x / (2 * k + 1))
    return F.when(z > 6, F.lit(0.0)).when(z < -6, F.lit(1.0)).when(z >= 0, 0.5 - half).otherwise(0.5 + half)


def regression_summary(df: DataFrame, by: str, x: str, y: str, least: int = 10) -> DataFrame:
    """By group of at least ``least`` rows: n, slope of y on x, R squared, Spearman's rho and its two-sided p."""
    ranked = average_rank(average_rank(df.select(by, x, y), x, "_rx", [by]), y, "_ry", [by])
    g = ranked.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"), F.corr("_rx", "_ry").alias("rho")).filter(F.col("n") >= least)
    rho, n = F.col("rho"), F.col("n")
    p = F.when(F.abs(rho) >= 1 - 1e-12, F.lit(0.0)).otherwise(t_two_sided(rho * F.sqrt((n - 2) / (1 - rho * rho)), n - 2))
    return g.withColumn("p", p)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation over rows that have both values; ties share their mean rank."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranked = average_rank(average_rank(both, x, "_rx"), y, "_ry")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for each pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)]))
    return one.select(rows.alias("x")).select("x.*")


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, groups, H corrected for ties and epsilon squared."""
    ranked = average_rank(df.filter(F.col(value).isNotNull()).select(group, value), value, "_r")
    ties = ranked.groupBy(value).agg(F.count(F.lit(1)).alias("_t")).agg(F.sum(F.pow("_t", 3) - F.col("_t")).alias("ties"))
    sums = ranked.groupBy(group).agg(F.sum("_r").alias("_s"), F.count(F.lit(1)).alias("_n")).agg(F.sum(F.col("_s") * F.col("_s") / F.col("_n")).alias("q"), F.sum("_n").alias("n"), F.count(F.lit(1)).alias("groups"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return sums.crossJoin(ties).select("n", "groups", h.alias("h"), (h / (n - 1)).alias("epsilon2"))


def with_chi2_p(test: DataFrame, statistic: str, groups: str = "groups") -> DataFrame:
    """A test's single row with p, the chi-square tail of its statistic at groups - 1 degrees of freedom; null without a statistic."""
    row = test.first()
    p = None if row is None or row[statistic] is None else chi2_tail(float(row[statistic]), int(row[groups]) - 1)
    return test.withColumn("p", F.lit(p).cast("double"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, rows, columns, chi-square and Cramér's V of two categories."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    ra, rb = cells.groupBy(a).agg(F.sum("o").alias("ra")), cells.groupBy(b).agg(F.sum("o").alias("rb"))
    n = cells.agg(F.sum("o").alias("n"))
    full = ra.crossJoin(F.broadcast(rb)).join(cells, [a, b], "left").na.fill(0, ["o"]).crossJoin(F.broadcast(n))
    e = F.col("ra") * F.col("rb") / F.col("n")
    one = full.agg(F.max("n").alias("n"), F.countDistinct(a).alias("rows"), F.countDistinct(b).alias("columns"), F.sum(F.pow(F.col("o") - e, 2) / e).alias("chi2"))
    return one.withColumn("v", F.sqrt(F.col("chi2") / (F.col("n") * (F.least("rows", "columns") - 1))))


def mann_whitney(df: DataFrame, flag: str, value: str) -> DataFrame:
    """n1, n2, U of the flagged rows, the rank-biserial correlation, and z and p that flagged values are greater.

    The normal approximation is corrected for ties and continuity.
    """
    ranked = average_rank(df.filter(F.col(value).isNotNull()).select(flag, value), value, "_r")
    ties = ranked.groupBy(value).agg(F.count(F.lit(1)).cast("double").alias("_t")).agg(F.sum(F.pow("_t", 3) - F.col("_t")).alias("_ties"))
    one = ranked.agg(F.count_if(F.col(flag)).alias("n1"), F.count_if(~F.col(flag)).alias("n2"), F.sum(F.when(F.col(flag), F.col("_r"))).alias("_s")).crossJoin(ties)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n, u = n1 + n2, F.col("_s") - n1 * (n1 + 1) / 2
    deviation = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("_ties") / (n * (n - 1))))
    z = (u - n1 * n2 / 2 - 0.5) / deviation
    return one.select("n1", "n2", u.alias("u"), (2 * u / (n1 * n2) - 1).alias("rank_biserial"), z.alias("z"), normal_upper(z).alias("p"))


def medians_by_quartile(df: DataFrame, flag: str, value: str, by: str, least: int = 3) -> DataFrame:
    """By quarter of ``by`` (bounds belong to the lower one) the medians of flagged and other rows, where both have ``least``."""
    cuts = df.agg(F.percentile(by, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    quarter = 1 + F.size(F.filter("_q", lambda q: F.col(by) > q))
    binned = df.filter(F.col(by).isNotNull()).crossJoin(F.broadcast(cuts)).withColumn("quarter", quarter)
    one, two = F.when(F.col(flag), F.col(value)), F.when(~F.col(flag), F.col(value))
    g = binned.groupBy("quarter").agg(F.count(one).alias("n1"), F.count(two).alias("n2"), F.median(one).alias("flagged"), F.median(two).alias("other"))
    return g.filter((F.col("n1") >= least) & (F.col("n2") >= least)).withColumn("difference", F.col("flagged") - F.col("other"))


def anomalies(df: DataFrame, key: str, value: str, group: str, count: str, least: int) -> DataFrame:
    """Log ratio to the group's median, its robust z over all rows, and a diagnosis."""
    med = df.groupBy(group).agg(F.median(value).alias("_m"))
    logs = df.join(med, group).withColumn("log_ratio", F.ln(F.col(value) / F.col("_m")))
    z = robust_z(logs.select(key, count, "log_ratio"), [], "log_ratio")
    odd = F.abs(F.col("z")) > 2.5
    return z.select(key, F.col("log_ratio"), "z", F.when(odd & (F.col(count) < least), "odd and few").when(odd, "odd").when(F.col(count) < least, "few").otherwise("plain").alias("diagnosis"))
