"""Insights over a measure: trend, correlation, extremes, shares, turning points, change detection."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.operators.compare import percentiles
from faultline.operators.series import PART_ROWS, series
from faultline.sources.scratch import saved


def trend(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, slope, r2) of y over x."""
    return df.groupBy(group).agg(F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"))


def trend_break(df: DataFrame, group: str, x: str, y: str, least: int = 3, abnormal_from: float = 0.5, rows: int = PART_ROWS) -> DataFrame:
    """(group, since, slope_before, slope_after, explained, abnormal): the place where two lines fit a series best.

    `since` is the x of the second line's first point (ties: the smallest); each line has `least` points or more. explained: the share of the one
    line's squared error that the second takes away; abnormal: at least `abnormal_from`. Every place is tried, on running sums of moments about the means; series that lie on one line give no row.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(group, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    s = series(known, [group], ["__x", "__y"], rows).whole({"__mx": F.avg("__x"), "__my": F.avg("__y")}).with_columns({"__x0": F.col("__x") - F.col("__mx"), "__y0": F.col("__y") - F.col("__my")})
    moments = {"n": F.lit(1.0), "x": F.col("__x0"), "y": F.col("__y0"), "xx": F.col("__x0") * F.col("__x0"), "xy": F.col("__x0") * F.col("__y0"), "yy": F.col("__y0") * F.col("__y0")}
    s = s.running({f"__a{m}": ("sum", c) for m, c in moments.items()}).whole({f"__t{m}": F.sum(c) for m, c in moments.items()})

    def line(of: Callable[[str], Column]) -> tuple[Column, Column]:
        """(slope, squared error) from the six sums."""
        sxx, sxy, syy = of("xx") - of("x") * of("x") / of("n"), of("xy") - of("x") * of("y") / of("n"), of("yy") - of("y") * of("y") / of("n")
        slope = F.when(sxx > 1e-12 * F.greatest(F.col("__txx"), F.lit(1e-300)), sxy / sxx)
        return slope, F.greatest(syy - F.coalesce(slope * sxy, F.lit(0.0)), F.lit(0.0))

    before, error_before = line(lambda m: F.col(f"__a{m}"))
    after, error_after = line(lambda m: F.col(f"__t{m}") - F.col(f"__a{m}"))
    _, error = line(lambda m: F.col(f"__t{m}"))
    tried = s.shifted({"__next": F.col("__x")}, ahead=True).rows.where((F.col("__an") >= least) & (F.col("__tn") - F.col("__an") >= least))
    tried = tried.select(group, F.col("__next").alias("since"), before.alias("slope_before"), after.alias("slope_after"), error.alias("one"), (error_before + error_after).alias("two"), F.col("__tyy").alias("all")).where(F.col("one") > 1e-9 * F.col("all"))
    best = tried.groupBy(group).agg(F.min(F.struct(F.round(F.col("two") / F.col("all"), 12).alias("e"), "since", "slope_before", "slope_after", (1 - F.col("two") / F.col("one")).alias("explained"))).alias("b"))
    return best.select(group, "b.since", "b.slope_before", "b.slope_after", "b.explained", (F.col("b.explained") >= abnormal_from).alias("abnormal"))


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation of the rows that have both; null where one of them does not vary (F.corr divides by zero there)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y))))


def pearson(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    return df.groupBy(group).agg(correlation(x, y).alias("pearson"))


#: Values whose ranks are broadcast; more are joined by value.
FEW_VALUES = 100_000


def _counted(df: DataFrame, group: str, c: str, *more: Column) -> DataFrame:
    """(group, __v, __c, ...): how many rows have a value; written once, as it is read several times."""
    return saved(df.groupBy(group, F.col(c).alias("__v")).agg(F.count(F.lit(1)).alias("__c"), *more), "counted")


def _doubled_ranks(counted: DataFrame, group: str, rows: int) -> DataFrame:
    """counted with __r, twice the mean place of equal values among their group's; nulls come first."""
    placed = series(counted, [group], ["__v"], rows).running({"__upto": ("sum", F.col("__c"))}).plain
    return placed.withColumn("__r", 2 * F.col("__upto") - F.col("__c") + 1).drop("__upto")


def spearman(df: DataFrame, group: str, x: str, y: str, rows: int = PART_ROWS) -> DataFrame:
    """Correlation of average ranks.

    Rows meet the ranks of one column, that of few values where there is one, and are summed by the other's values, whose ranks then meet no row. Doubled ranks are integers, so the sums are exact.
    """
    first = _counted(df, group, x)
    if first.count() > FEW_VALUES:
        other = _counted(df, group, y)
        if other.count() < first.count():
            first, x, y = other, y, x
    ranks = _doubled_ranks(first, group, rows)
    at = ranks.select(F.struct(group, "__v").alias("__value"), "__r")
    met = df.select(group, y, F.struct(group, F.col(x).alias("__v")).alias("__value")).join(F.broadcast(at) if first.count() <= FEW_VALUES else at, "__value")
    others = _doubled_ranks(_counted(met, group, y, F.sum("__r").alias("__s")), group, rows)
    exact = lambda *cs: reduce(Column.__mul__, [c.cast("decimal(20,0)") for c in cs]).cast("decimal(38,0)")
    c, r, none = F.col("__c"), F.col("__r"), F.lit(0).cast("decimal(38,0)")
    parts = others.select(group, c, exact(F.col("__s"), r).alias("xy"), none.alias("xx"), exact(c, r, r).alias("yy"))
    parts = parts.unionByName(ranks.select(group, F.lit(0).cast("long").alias("__c"), none.alias("xy"), exact(c, r, r).alias("xx"), none.alias("yy")))
    sums = parts.groupBy(group).agg(F.sum("__c").alias("n"), *[F.sum(m).alias(m) for m in ("xy", "xx", "yy")])
    about = lambda m: (F.col(m) - exact(F.col("n"), F.col("n") + 1, F.col("n") + 1)).cast("double")
    return sums.select(group, F.try_divide(about("xy"), F.sqrt(about("xx")) * F.sqrt(about("yy"))).alias("spearman"))


def statistics(df: DataFrame, group: str, y: str) -> DataFrame:
    """Quartiles are exact (see `percentiles`)."""
    moments = df.groupBy(group).agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"))
    met = moments.join(percentiles(df, group, y, {"q1": 0.25, "median": 0.5, "q3": 0.75}), group, "left")
    return met.select(group, "mean", "std", "q1", "median", "q3", F.try_divide("std", "mean").alias("volatility"))


#: Groups whose fences are broadcast; more are joined by key.
FEW_GROUPS = 100_000


def outliers(df: DataFrame, group: str, y: str, spread: float = 1.5) -> DataFrame:
    """Rows outside the quartiles by `spread` interquartile ranges."""
    q = percentiles(df, group, y, {"q1": 0.25, "q3": 0.75})
    fences = q.select(group, (F.col("q1") - spread * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + spread * (F.col("q3") - F.col("q1"))).alias("high"))
    few = df.select(group).distinct().count() <= FEW_GROUPS
    return df.join(F.broadcast(fences) if few else fences, group).where((F.col(y) < F.col("low")) | (F.col(y) > F.col("high")))


def extremes(df: DataFrame, group: str, y: str, label: str) -> DataFrame:
    """(group, top_label, top, low_label, low); ties go to the larger and the smaller label."""
    return df.groupBy(group).agg(F.max_by(label, F.struct(y, label)).alias("top_label"), F.max(y).alias("top"), F.min_by(label, F.struct(y, label)).alias("low_label"), F.min(y).alias("low"))


def majority(df: DataFrame, group: str, y: str, label: str, share: float = 0.5) -> DataFrame:
    """(group, label, share) of labels that hold more than `share` of a group's sum."""
    sums = df.groupBy(group, label).agg(F.sum(y).alias("part"))
    return sums.withColumn("share", F.try_divide(F.col("part"), F.sum("part").over(W.partitionBy(group)))).where(F.col("share") > share).select(group, label, "share")


def turning_points(df: DataFrame, group: str, x: str, y: str, rows: int = PART_ROWS) -> DataFrame:
    """Points of a series (a row for each x) where the sign of the change flips."""
    s = series(df, [group], [x], rows).shifted({"__was": F.col(y)}).shifted({"__next": F.col(y)}, ahead=True)
    return s.plain.withColumns({"change": F.col(y) - F.col("__was"), "next_change": F.col("__next") - F.col(y)}).where(F.col("change") * F.col("next_change") < 0).drop("__was", "__next")


def page_hinkley(df: DataFrame, group: str, x: str, y: str, delta: float = 0.005, limit: float = 50.0, rows: int = PART_ROWS) -> DataFrame:
    """Points where the cumulated deviation from the running mean exceeds its running minimum by `limit`."""
    s = series(df, [group], [x], rows).running({"__sum": ("sum", F.col(y)), "__n": ("count", F.col(y))})
    s = s.with_columns({"__dev": F.col(y) - F.try_divide("__sum", "__n") - delta}).running({"__m": ("sum", F.col("__dev"))}).running({"__low": ("min", F.col("__m"))})
    return s.plain.withColumn("ph", F.col("__m") - F.col("__low")).where(F.col("ph") > limit).select(group, x, y, "ph")


def difference_outliers(df: DataFrame, group: str, x: str, y: str, z: float = 2.0, rows: int = PART_ROWS) -> DataFrame:
    """Points whose change from the one before is more than z standard deviations from the mean change."""
    s = series(df, [group], [x], rows).shifted({"__was": F.col(y)}).with_columns({"d": F.col(y) - F.col("__was")}).whole({"__mean": F.avg("d"), "__std": F.stddev_samp("d")})
    return s.plain.withColumn("z", F.try_divide(F.col("d") - F.col("__mean"), F.col("__std"))).where(F.abs("z") > z).select(group, x, y, "d", "z")


#: Insights that tell the same of a chart: the stronger one stands for both.
ALIKE = {"pearson": "correlation", "spearman": "correlation"}


def scored(df: DataFrame, group: str, x: str, y: str, rows: int = PART_ROWS, limit: float = 50.0, z: float = 2.0) -> DataFrame:
    """(group, insight, at, strength) of every insight over charts with a row for each x: strength lies between 0 and 1, so that kinds can be compared; at: the x that is meant, or null.

    Trend: r2; break of a trend and majority: their shares; correlations: their size; points outside the fences: what exceeds them against that and the
    interquartile range; turning points: the smaller change against the range; shifts and changes: what exceeds the limit, as a share of the whole; volatility: v / (1 + v).
    The charts are written first, so that what made them runs once. A strength that is null or no number gives no row.
    """
    df = saved(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(group, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)), "charts")
    spread = extremes(df, group, y, x).select(group, (F.col("top") - F.col("low")).alias("spread"))
    q = percentiles(df, group, y, {"q1": 0.25, "q3": 0.75}, rows).withColumn("iqr", F.col("q3") - F.col("q1"))
    beyond = F.greatest(F.col("q1") - 1.5 * F.col("iqr") - F.col(y), F.col(y) - F.col("q3") - 1.5 * F.col("iqr"))
    volatility = df.groupBy(group).agg(F.abs(F.try_divide(F.stddev_samp(y), F.avg(y))).alias("v"))
    at, none = F.col(x), F.lit(None).cast("double")
    found = {
        "overall_trend": (trend(df, group, x, y).where("slope <> 0"), none, F.col("r2")),
        "abnormal_trend": (trend_break(df, group, x, y, rows=rows).where("abnormal"), F.col("since"), F.col("explained")),
        "pearson": (pearson(df, group, x, y), none, F.abs("pearson")),
        "spearman": (spearman(df, group, x, y, rows), none, F.abs("spearman")),
        "majority": (majority(df, group, y, x), at, F.col("share")),
        "statistics_abnormal": (df.join(q, group).withColumn("beyond", beyond).where("beyond > 0"), at, F.col("beyond") / (F.col("beyond") + F.col("iqr"))),
        "turning_point": (turning_points(df, group, x, y, rows).join(spread, group), at, F.least(F.abs("change"), F.abs("next_change")) / F.col("spread")),
        "page_hinkley": (page_hinkley(df, group, x, y, limit=limit, rows=rows), at, 1 - F.lit(limit) / F.col("ph")),
        "difference_outlier": (difference_outliers(df, group, x, y, z, rows), at, 1 - F.lit(z) / F.abs("z")),
        "volatility": (volatility, none, F.col("v") / (1 + F.col("v"))),
    }
    told = [d.select(group, F.lit(name).alias("insight"), a.alias("at"), F.round(strength, 9).alias("strength")) for name, (d, a, strength) in found.items()]
    known = reduce(DataFrame.unionByName, told).where(F.col("strength").isNotNull() & ~F.isnan("strength"))
    return known.withColumn("strength", F.least("strength", F.lit(1.0)))


def best(found: DataFrame, group: str, k: int = 6) -> DataFrame:
    """(group, place, insight, at, strength): the k strongest insights of each chart, each kind once, at its strongest place (ties: the smallest x), and one of kinds that tell the same (ALIKE).

    Rows of the form of `scored`; ties of strength go by name. Two exchanges at most: a group has few kinds once each is reduced to its best row.
    """
    kind = F.coalesce(*[F.when(F.col("insight") == i, a) for i, a in ALIKE.items()], F.col("insight"))
    order = F.struct((-F.col("strength")).alias("s"), "insight", F.coalesce("at", F.lit(0.0)).alias("x"))
    one = found.groupBy(group, kind.alias("__kind")).agg(F.min_by(F.struct("insight", "at", "strength"), order).alias("b"))
    w = W.partitionBy(group).orderBy(F.desc("b.strength"), "b.insight")
    return one.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(group, "place", "b.*")
