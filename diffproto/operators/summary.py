"""Summaries of run records (one row per run: model, m, seed[, run], metrics).

All are plain grouped aggregates: partial aggregation map-side, one row per
group out.  Standard deviations come in both kinds the reference uses:
population (numpy's default) and sample (pandas' default).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

R = 4


def mean_std(runs: DataFrame, by: Sequence[str], metrics: Sequence[str], kind: str = "pop",
             mean_fmt: str = "mean_{}", std_fmt: str = "std_{}", round_to: int | None = R) -> DataFrame:
    """Per group: mean and standard deviation of each metric.

    ``kind='pop'`` divides by n, ``kind='samp'`` by n - 1 (NULL for one row).
    Column names follow ``mean_fmt`` / ``std_fmt`` (never repeated)."""
    std = {"pop": F.stddev_pop, "samp": F.stddev_samp}[kind]
    rnd = (lambda c: F.round(c, round_to)) if round_to is not None else (lambda c: c)
    aggs = [rnd(F.avg(m)).alias(mean_fmt.format(m)) for m in metrics]
    aggs += [rnd(std(m)).alias(std_fmt.format(m)) for m in metrics]
    return runs.groupBy(*by).agg(*aggs)


def runs_mean_stdpop(runs: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("model", "m")) -> DataFrame:
    return mean_std(runs, by, metrics, "pop")


def runs_mean_stdsamp(runs: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("model", "m")) -> DataFrame:
    return mean_std(runs, by, metrics, "samp", "{}_mean", "{}_sd")


def trend_series(runs: DataFrame, metrics: Sequence[str] = ("accuracy", "f1"),
                 by: Sequence[str] = ("model", "m")) -> DataFrame:
    """Mean of each metric per (model, m): the series a trend plot draws."""
    return runs.groupBy(*by).agg(*[F.round(F.avg(m), R).alias(m) for m in metrics])


def average_runs(runs: DataFrame, metrics: Sequence[str] = ("accuracy", "f1"),
                 by: Sequence[str] = ("model", "seed", "m")) -> DataFrame:
    """Mean over the repeated runs of each (model, seed, m)."""
    return runs.groupBy(*by).agg(*[F.round(F.avg(m), R).alias(m) for m in metrics],
                                 F.count(F.lit(1)).alias("n_runs"))


def point(series: DataFrame, **where) -> DataFrame:
    """Point lookup, e.g. ``point(trend, m=10, model='x')``."""
    cond = None
    for k, v in where.items():
        c = F.col(k) == F.lit(v)
        cond = c if cond is None else cond & c
    return series.filter(cond) if cond is not None else series
