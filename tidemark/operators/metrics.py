"""Histograms, quantiles, rings and moving values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the latency histogram, and of the rings in milliseconds (fixed values).
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
RINGS = (6, 15, 50, 100, 200, 300)
SLACK_MS = 2
SAMPLES = 20
ALPHA = 0.3


def bucket_counts(values: DataFrame, value: str, bounds: tuple[float, ...] = BOUNDS, by: list[str] | None = None) -> DataFrame:
    """(by, bucket, n) for every bound and the overflow, each value in the first bucket whose bound it doesn't exceed."""
    v = F.col(value)
    edges = [F.lit(b) for b in bounds]
    counts = []
    for n in range(len(bounds) + 1):
        inside = (v <= edges[n] if n < len(bounds) else F.lit(True)) & (v > edges[n - 1] if n else F.lit(True))
        counts.append(F.struct(F.lit(n).alias("bucket"), F.count(F.when(inside, 1)).alias("n")))
    one = values.groupBy(*(by or [])).agg(F.array(*counts).alias("h"))
    return one.select(*(by or []), F.inline("h"))


def quantile(counts: DataFrame, q: float, bounds: tuple[float, ...] = BOUNDS, by: list[str] | None = None) -> DataFrame:
    """The q-quantile of each histogram: rank q * n, linear inside a bucket, the first bucket's own bound, the last bound
    for the overflow; null if there are no values or q lies outside 0 to 1."""
    by = by or []
    upper = F.element_at(F.array(*[F.lit(float(b)) for b in bounds]), F.least(F.col("bucket") + 1, F.lit(len(bounds))))
    lower = F.when(F.col("bucket") == 0, upper).otherwise(F.element_at(F.array(*[F.lit(float(b)) for b in bounds]), F.greatest(F.col("bucket"), F.lit(1))))
    order = Window.partitionBy(*by, F.lit(0)).orderBy("bucket")
    total = Window.partitionBy(*by, F.lit(0))
    run = counts.withColumn("_to", F.sum("n").over(order)).withColumn("_all", F.sum("n").over(total)).withColumn("_rank", F.lit(float(q)) * F.col("_all"))
    here = (F.col("n") > 0) & (F.col("_to") >= F.col("_rank"))
    inside = lower + (upper - lower) * (F.col("_rank") - (F.col("_to") - F.col("n"))) / F.col("n")
    value = F.when(F.col("bucket") == 0, upper).when(F.col("bucket") == len(bounds), F.lit(float(bounds[-1]))).otherwise(inside)
    if not 0 <= q <= 1:
        value = F.lit(None).cast("double")
    return run.groupBy(*by).agg(F.min_by(F.when(here, value), F.when(here, F.col("bucket"))).alias("quantile"))


def merge(*histograms: DataFrame) -> DataFrame:
    """Histograms over the same bounds added up."""
    both = histograms[0]
    for h in histograms[1:]:
        both = both.unionByName(h)
    return both.groupBy([c for c in both.columns if c != "n"]).agg(F.sum("n").alias("n"))


def rolling(counts: DataFrame, chunk: str, chunks: int, last: int) -> DataFrame:
    """Histograms of the last `chunks` chunks (numbered by a column) up to chunk `last`."""
    return merge(counts.where((F.col(chunk) > last - chunks) & (F.col(chunk) <= last)).drop(chunk))


def ring(rtt: Column) -> Column:
    """The ring of a round trip in milliseconds; what is beyond the last bound is in the last ring."""
    out = None
    for n, bound in enumerate(RINGS):
        out = (F.when if out is None else out.when)(rtt < bound, n)
    return out.otherwise(len(RINGS) - 1)


def ring_steps(samples: Column) -> Column:
    """The ring after a list of round trips in order: one ring a sample at most, and only SLACK_MS past a bound."""
    lows = F.array(*[F.lit(float(x)) for x in (0, *RINGS[:-1])])
    highs = F.array(*[F.lit(float(x)) for x in RINGS])

    def step(now: Column, rtt: Column) -> Column:
        up = (rtt >= F.element_at(highs, now + 1) + SLACK_MS) & (now < len(RINGS) - 1)
        down = (rtt < F.element_at(lows, now + 1) - SLACK_MS + 1) & (now > 0)
        return F.when(rtt.isNull(), now).when(up, now + 1).when(down, now - 1).otherwise(now)

    first = ring(F.element_at(samples, 1)).cast("int")
    return F.when(F.size(samples) > 0, F.aggregate(F.slice(samples, 2, F.greatest(F.size(samples) - 1, F.lit(0))), first, step))


def rolling_min(df: DataFrame, value: str, by: list[str], order: list[str], samples: int = SAMPLES) -> DataFrame:
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - samples, 0)
    return df.withColumn("rolling_min", F.min(value).over(frame))


def ema(samples: Column, alpha: float = ALPHA) -> Column:
    """The exponentially weighted mean of a list in order, from its first value on."""
    return F.when(F.size(samples) > 0, F.aggregate(F.slice(samples, 2, F.greatest(F.size(samples) - 1, F.lit(0))), F.element_at(samples, 1).cast("double"), lambda acc, x: acc * F.lit(1 - alpha) + x * F.lit(alpha)))


def healthy(gaps: int, queue: int, p99_lag: float, most_gaps: int = 100, most_queue: int = 16_000, most_lag: float = 3.0) -> bool:
    return gaps <= most_gaps and not (queue > most_queue and p99_lag > most_lag)
