"""Divergences between two distributions given as rows (bin, p, q)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspan.functions.binning import left_closed_bin

EPS = 1e-12


def _kl(p: Column, q: Column, eps: float) -> Column:
    """Aggregate: the divergence of p from q in nats, after adding eps and normalising; null for undefined rows.

    sum(a ln(a / b)) of the normalised a and b, with their sums taken out of the logarithm, so it is one pass.
    """
    x, y = p + eps, q + eps
    return F.sum(x * F.log(x / y)) / F.sum(x) + F.log(F.sum(y) / F.sum(x))


def kl_divergence(df: DataFrame, p: str = "p", q: str = "q", eps: float = EPS) -> DataFrame:
    return df.agg(_kl(F.col(p), F.col(q), eps).alias("value"))


def js_divergence(df: DataFrame, p: str = "p", q: str = "q", eps: float = EPS) -> DataFrame:
    """Half the divergences of p and q from their mean; the mean is taken before normalising."""
    one, two = F.col(p), F.col(q)
    mid = (one + two) / 2
    return df.agg((0.5 * _kl(one, mid, eps) + 0.5 * _kl(two, mid, eps)).alias("value"))


def histogram(df: DataFrame, column: str, is_ood: Column, bins: int = 20) -> DataFrame:
    """(bin, p, q): densities of in- and out-of-distribution values over bins set by the former; empty bins are there.

    Two passes over df, one for the range and one for the counts; the result is a local table of bins.
    """
    x = F.col(column).cast("double")
    values = df.select(x.alias("x"), is_ood.alias("ood")).where("x IS NOT NULL AND NOT isnan(x)")
    lo, hi = values.where("NOT ood").agg(F.min("x"), F.max("x")).first()
    p, q = [0] * bins, [0] * bins
    if lo is not None:
        binned = values.select(left_closed_bin(F.col("x"), F.lit(lo), F.lit(hi), bins).alias("bin"), "ood").where("bin IS NOT NULL")
        found = binned.groupBy("bin").agg(F.count_if(~F.col("ood")).alias("p"), F.count_if("ood").alias("q")).collect()  # a row a bin
        for r in found:
            p[r["bin"]], q[r["bin"]] = r["p"], r["q"]
    width = ((hi - lo) or 1.0) / bins if lo is not None else 1.0
    share = lambda counts: [c / (sum(counts) * width) if sum(counts) else None for c in counts]
    return df.sparkSession.createDataFrame(list(zip(range(bins), share(p), share(q), strict=True)), "bin int, p double, q double")


def histogram_divergence(df: DataFrame, column: str, is_ood: Column, bins: int = 20, method: str = "js") -> DataFrame:
    """One row (value): null where either side has no value within the bins."""
    if method not in ("kl", "js"):
        raise ValueError(f"Unknown divergence method: {method}")
    densities = histogram(df, column, is_ood, bins)
    return (kl_divergence if method == "kl" else js_divergence)(densities)
