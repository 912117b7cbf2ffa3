"""Statistics over earlier runs, and estimates from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timing import positive


def transcription_samples(reports: DataFrame) -> DataFrame:
    """Usable runs of reports (path, mtime, status, media_duration_seconds, processing_seconds, realtime_factor, ...)."""
    rows = reports.where(F.col("status").isin("success", "suspicious_incomplete"))
    rows = rows.withColumns({c: positive(F.col(c)) for c in ("media_duration_seconds", "processing_seconds", "realtime_factor")})
    rows = rows.withColumn("realtime_factor", F.coalesce("realtime_factor", F.col("processing_seconds") / F.col("media_duration_seconds")))
    return rows.where("media_duration_seconds is not null and processing_seconds is not null and realtime_factor is not null")


def translation_samples(reports: DataFrame) -> DataFrame:
    rows = reports.where("status = 'success'").withColumns({"subtitle_count": positive(F.col("subtitle_count")).cast("long"), "processing_seconds": positive(F.col("processing_seconds"))})
    rows = rows.where("subtitle_count > 0 and processing_seconds is not null")
    return rows.withColumn("seconds_per_subtitle", F.col("processing_seconds") / F.col("subtitle_count"))


def history_ratios(reports: DataFrame, asr_backend: str | None = None, unnamed: str = "default") -> DataFrame:
    """Realtime factors of all runs of a backend, whatever their status (of all backends if none is
    given); runs that name no backend count as ``unnamed``."""
    named = F.coalesce(F.when(F.col("asr_backend") != "", F.col("asr_backend")), F.lit(unnamed))
    rows = reports if asr_backend is None else reports.where(named == asr_backend)
    media = F.coalesce(positive(F.col("media_duration_seconds")), positive(F.col("audio_duration_seconds")))
    return rows.withColumns({"asr_backend": named, "ratio": positive(F.col("processing_seconds")) / media}).where("ratio is not null")


def _joined(left: DataFrame, right: DataFrame, by: list[str], how: str) -> DataFrame:
    """A join on keys that may be null, or on none where both sides are one group."""
    right = right.withColumnsRenamed({c: f"right_{c}" for c in by}).withColumn("right_all", F.lit(1))
    met = F.lit(1) == F.col("right_all")
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"right_{c}"))
    return left.join(right, met, how).drop("right_all", *[f"right_{c}" for c in by])


#: Accuracy of the sketch that brackets a percentile: its rank is off by one in SKETCH at most.
SKETCH = 10_000


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], by: list[str]) -> DataFrame:
    """Exact interpolated percentiles of each group by counts over value ranges: the columns ``by``, n and the names of
    ``shares``. Nulls do not count.

    A sketch of bounded size brackets each percentile; one more pass counts what lies below the bracket and each value
    inside it, which is a few ten-thousandths of a group's values. A group without values has nulls."""
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    wanted = list(shares.items())
    spread = 2.0 / SKETCH
    marks = [m for _, q in wanted for m in (max(0.0, q - spread), min(1.0, q + spread))]
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("v", marks, SKETCH).alias("marks"))
    met = _joined(rows, found, by, "inner").select(*by, "v", "n", "marks")
    few = F.col("n") <= 4 * SKETCH  # where a bracket would be a rank or two, all values are counted
    low = F.when(few, F.lit(float("-inf"))).otherwise(F.col("marks")[2 * F.col("k")])
    high = F.when(few, F.lit(float("inf"))).otherwise(F.col("marks")[2 * F.col("k") + 1])
    each = met.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(len(wanted))]))).where(F.col("v") <= high)
    counted = each.groupBy(*by, "k", "n", F.when(F.col("v") >= low, F.col("v")).alias("v")).agg(F.count("*").alias("count"))  # null: below
    order = Window.partitionBy(*by, "k").orderBy(F.col("v").asc_nulls_first())
    upto = counted.withColumn("upto", F.sum("count").over(order))
    at = (F.col("n") - 1) * F.element_at(F.array(*[F.lit(q) for _, q in wanted]), F.col("k") + 1)
    upto = upto.withColumns({"lower": F.floor(at), "share": at - F.floor(at)})
    rank = lambda r: F.min(F.when(F.col("upto") > r, F.struct("upto", "v")))
    picked = upto.groupBy(*by, "k", "n", "lower", "share").agg(rank(F.col("lower")).alias("a"), rank(F.least(F.col("lower") + 1, F.col("n") - 1)).alias("b"))
    sound = F.assert_true(F.col("a.v").isNotNull() & F.col("b.v").isNotNull(), "a percentile lies outside its bracket")
    exact = F.when((F.col("share") == 0) | (F.col("a.v") == F.col("b.v")), F.col("a.v")).otherwise((1 - F.col("share")) * F.col("a.v") + F.col("share") * F.col("b.v"))
    picked = picked.withColumn("p", F.when(sound.isNull(), exact))
    return picked.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("k") == k, F.col("p"))).alias(name) for k, (name, _) in enumerate(wanted)])


def history_summary(samples: DataFrame, value: str = "realtime_factor", order: str = "mtime", by: list[str] | None = None) -> DataFrame:
    """Count, mean, median, 75th percentile (interpolated), extremes and latest of ``value``; no group is held in one
    place, whatever its size."""
    keys = by or []
    plain = samples.groupBy(*keys).agg(F.count(value).alias("samples"), F.avg(value).alias("average"), F.min(value).alias("fastest"), F.max(value).alias("slowest"), F.max_by(value, order).alias("latest"))
    ranked = percentiles(samples, value, {"median": 0.5, "p75": 0.75}, keys).drop("n")
    return _joined(plain, ranked, keys, "left").select(*keys, "samples", "average", "median", "p75", "fastest", "slowest", "latest")


def work_estimate(targets: DataFrame, summary: DataFrame, work: str) -> DataFrame:
    """Seconds that each target's ``work`` will take by each statistic of a summary of one row."""
    rows = targets.join(F.broadcast(summary.limit(1)), how="cross")
    return rows.select(*targets.columns, *[(F.col(work) * F.col(c)).alias(f"{c}_based_s") for c in ("average", "median", "p75", "latest", "slowest")])


def recent_average(rows: DataFrame, value: str, order: str = "mtime", n: int = 10, by: list[str] | None = None) -> DataFrame:
    """Mean of the ``n`` newest values of each group."""
    recent = most_recent(rows, n, order, by)
    return recent.groupBy(*(by or [])).agg(F.avg(value).alias("recent_average"), F.count("*").alias("samples"))


def most_recent(rows: DataFrame, n: int, order: str = "mtime", by: list[str] | None = None) -> DataFrame:
    if not by:
        return rows.orderBy(F.col(order).desc()).limit(n)
    window = Window.partitionBy(*by).orderBy(F.col(order).desc())
    return rows.withColumn("recency", F.row_number().over(window)).where(F.col("recency") <= n).drop("recency")


def exact_sum(value: Column) -> Column:
    """Sum of doubles whose order does not matter: up to nine decimals (below 1e15) add up as decimals, and what these
    leave of a number as doubles. So sums of hundredths that end in a half round alike on any number of tasks."""
    whole = F.coalesce(F.when(F.abs(value) < 1e15, value.cast("decimal(24,9)")), F.lit(0).cast("decimal(24,9)"))
    return F.sum(whole).cast("double") + F.sum(value - whole.cast("double"))


def folder_totals(rows: DataFrame, columns: list[str], by: str = "folder") -> DataFrame:
    """Sums over a folder; a sum of nothing above zero is null."""
    total = lambda c: exact_sum(F.coalesce(positive(F.col(c)), F.lit(0.0)))
    return rows.groupBy(by).agg(*[F.nullif(total(c), F.lit(0.0)).alias(c) for c in columns])
