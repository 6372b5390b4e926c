"""Baseline against anomaly window, for one incident or for many at once; percentiles, counters as rates, samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.expressions import change_percentage
from faultline.operators.series import PART_ROWS, fits, series
from faultline.plans.windows import WindowSpec, in_windows


def all_known(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def percentiles(df: DataFrame, keys: str | list[str], y: str | Column, at: dict[str, float], rows: int = PART_ROWS) -> DataFrame:
    """(keys, the names in at): exact percentiles with linear interpolation, of values that are not null.

    Equal values are counted before they are ordered, so ties cost nothing, and a group of many values is ordered in parts.
    """
    keys = [keys] if isinstance(keys, str) else keys
    counted = df.select(*keys, (F.col(y) if isinstance(y, str) else y).cast("double").alias("__y")).where(F.col("__y").isNotNull()).groupBy(*keys, "__y").agg(F.count(F.lit(1)).alias("__c"))
    placed = series(counted, keys, ["__y"], rows).running({"__upto": ("sum", F.col("__c"))}).whole({"__n": F.sum("__c")})
    place = lambda p: F.lit(p) * (F.col("__n") - 1) + 1
    holds = lambda r: (F.col("__upto") - F.col("__c") < r) & (r <= F.col("__upto"))
    low = lambda p: F.max(F.when(holds(F.floor(place(p))), F.col("__y")))
    high = lambda p: F.max(F.when(holds(F.ceil(place(p))), F.col("__y")))
    share = lambda p: F.max(place(p) - F.floor(place(p)))
    near = reduce(lambda a, b: a | b, [holds(f(place(p))) for p in at.values() for f in (F.floor, F.ceil)])
    # an end that is infinite counts as it is, where there is nothing between the two
    between = lambda p: F.when(low(p) == high(p), low(p)).otherwise(low(p) + (high(p) - low(p)) * share(p))
    return placed.rows.where(near).groupBy(*keys).agg(*[between(p).alias(name) for name, p in at.items()])


def grouped(rows: DataFrame, keys: list[str], aggregates: list[Column], at: dict[str, tuple[Column, float]], limit: int = PART_ROWS) -> DataFrame:
    """Aggregates and exact percentiles (name -> (value, share)) of each key's rows.

    Where no key has over `limit` rows one aggregate gives both; else percentiles come from counted values, as one buffer could not hold a key's.
    """
    if fits(rows, keys, limit):
        return rows.groupBy(*keys).agg(*aggregates, *[F.percentile(v, F.lit(p)).alias(name) for name, (v, p) in at.items()])
    out = rows.groupBy(*keys).agg(*aggregates)
    for name, (v, p) in at.items():
        one = percentiles(rows, keys, v, {name: p}, limit).select(F.struct(*keys).alias("__key"), name)
        out = out.withColumn("__key", F.struct(*keys)).join(one, "__key", "left").drop("__key")
    return out


def _compared(rows: DataFrame, keys: list[str], base: Column, anomaly: Column, time: str, value: str, first_above: dict[str, float] | None, limit: int) -> DataFrame:
    """Statistics of both windows by conditional aggregation, for groups with a row in the anomaly window; a missing baseline is 0."""
    v = F.col(value).cast("double")
    b, a = F.when(base, v), F.when(anomaly, v)
    statistics = [
        F.avg(b).alias("baseline_value"),
        F.stddev_samp(b).alias("baseline_std"),
        F.avg(a).alias("anomaly_value"),
        F.max(a).alias("anomaly_max"),
        F.min(a).alias("anomaly_min"),
        F.sum(a).alias("anomaly_sum"),
        F.stddev_samp(a).alias("anomaly_std"),
        F.count_if(anomaly).alias("n_anomaly"),
        F.count_if(base).alias("n_baseline"),
        *[F.min(F.when(anomaly & (v > x), F.col(time))).alias(c) for c, x in (first_above or {}).items()],
    ]
    stats = grouped(rows, keys, statistics, {"baseline_p99": (b, 0.99)}, limit)
    stats = stats.where("n_anomaly > 0").fillna(0.0, ["baseline_value", "baseline_std", "baseline_p99", "anomaly_value", "anomaly_max", "anomaly_min", "anomaly_sum", "anomaly_std"])
    return stats.withColumn("change_percentage", change_percentage(F.col("anomaly_value"), F.col("baseline_value")))


def compare(long: DataFrame, keys: list[str], spec: WindowSpec, time: str = "time", value: str = "value", kind: str = "timestamp_ntz", need_baseline: bool = False, first_above: dict[str, float] | None = None, limit: int = PART_ROWS) -> DataFrame:
    """One shuffle for both windows of an incident; see _compared.

    need_baseline: no result at all where the baseline window is empty. first_above: column -> value that the first time refers to.
    """
    base, anomaly = spec.in_baseline(time, kind), spec.in_anomaly(time, kind)
    stats = _compared(long.where((base | anomaly) & all_known(keys)), keys, base, anomaly, time, value, first_above, limit)
    if need_baseline:
        stats = stats.join(F.broadcast(long.where(base).limit(1).select(F.lit(True).alias("any_baseline"))), F.lit(True), "left_semi")
    return stats


def compare_windows(long: DataFrame, keys: list[str], windows: DataFrame, ids: list[str], time: str = "time", value: str = "value", first_above: dict[str, float] | None = None, limit: int = PART_ROWS) -> DataFrame:
    """compare() for every window of a table (see windows.incident_table) by one scan; ids: the columns that name a window."""
    met = in_windows(long.where(all_known(keys)), windows, time)
    named = met.withColumns({i: F.col(f"window.`{i}`") for i in ids})
    return _compared(named, [*ids, *keys], F.col("__base"), F.col("__anomaly"), time, value, first_above, limit)


def counter_rates(long: DataFrame, keys: list[str], is_counter: Column, name: Column, spec: WindowSpec | None = None, time: str = "time", value: str = "value", metric: str = "kpi_key", kind: str = "timestamp_ntz", tie: str | None = None, drop_first: bool = False, limit: int = PART_ROWS) -> DataFrame:
    """Counters as change per second within each window, under their rate's name; gauges stay. The first value of a series is 0 (drop_first: is left out).

    Series of over `limit` rows are worked on in parts; their times, or time and tie, should differ.
    """
    part = F.when(spec.in_baseline(time, kind), 0).when(spec.in_anomaly(time, kind), 1) if spec else F.lit(0)
    own = series(long.withColumn("__window", part), [*keys, metric, "__window"], [time, *([tie] if tie else [])], limit)
    marked = own.shifted({"__time": F.col(time), "__was": F.col(value)}).plain
    seconds = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("__time").cast("timestamp"))) / 1e6
    marked = marked.withColumns({"__counter": is_counter, "__s": seconds, "__d": F.col(value) - F.col("__was")})
    if drop_first:
        marked = marked.where(~F.col("__counter") | F.col("__s").isNotNull())
    rate = F.coalesce(F.when(F.col("__s") > 0, F.col("__d") / F.col("__s")), F.lit(0.0))
    return marked.withColumns({value: F.when(F.col("__counter"), rate).otherwise(F.col(value)), metric: F.when(F.col("__counter"), name).otherwise(F.col(metric))}).drop("__counter", "__s", "__d", "__time", "__was", "__window")


def numbered(df: DataFrame, value: Column, order: list[Column], by: list[str] | None = None, rows: int = PART_ROWS) -> DataFrame:
    """df with __rank, a row's place (from 1) in its group by value and order, and __n, the group's rows."""
    names = [f"__o{i}" for i in range(len(order) + 1)]
    marked = df.withColumns(dict(zip(names, [value, *order], strict=True)))
    return series(marked, by or [], names, rows).running({"__rank": ("count", F.lit(1))}).whole({"__n": F.count(F.lit(1))}).plain.drop(*names)


def systematic_sample(df: DataFrame, limit: int, time: str = "time", tie: str | None = None, seed: int = 42, rows: int = PART_ROWS) -> DataFrame:
    """Every (n // limit)-th row in order of time; if that is still over limit, the rows of smallest hash."""
    n = df.count()
    step = max(n // max(limit, 1), 1)
    order = [F.col(time), *([F.col(tie)] if tie else [])]
    kept = numbered(df, order[0], order[1:], rows=rows).where((F.col("__rank") - 1) % step == 0)
    if -(-n // step) > limit:
        kept = kept.orderBy(F.xxhash64(F.lit(seed), *order), *order).limit(limit)
    return kept.drop("__rank", "__n")
