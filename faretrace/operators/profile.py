"""Audits and profiles: distributions, missingness, coverage, cadence, cross-tabs.

Whole-table facts come from one aggregate; anything that needs order statistics
goes through ``exact_quantiles``; two-level statistics pre-aggregate first so
that no group is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faretrace.functions import frames
from faretrace.functions.frames import ratio
from faretrace.functions.scalars import horizon_bin, horizon_rank, month_key, percent
from faretrace.params import DEFAULTS, HORIZON_LABELS, LENGTH_LEVELS, Params
from faretrace.plans.quantiles import GROUP, collapsed, exact_quantiles, quantiles_of
from faretrace.plans.trajectory import Trajectory, on_trajectories
from faretrace.schema import FEATURE_GROUPS

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
DAY_NAMES = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def column_name(value: str) -> str:
    """A pivoted value as a plain identifier."""
    return value.replace("-", "_")


# ---- distributions -------------------------------------------------------


ROWS = "count(1) AS rows"


def exprs(*texts: str) -> list[Column]:
    return [F.expr(t) for t in texts]


def _group_keys(by: Sequence[str]) -> list[str]:
    return [f"{GROUP}{i}" for i in range(len(by))]


def _moments(table: DataFrame, by: Sequence[str], count: str) -> DataFrame:
    """count, mean, std, min, max of the values of a ``collapsed`` table per group, NULL groups too."""
    keys = _group_keys(by)
    first = table.groupBy(*keys).agg(*exprs(
        f"coalesce(sum(CASE WHEN v IS NOT NULL THEN n END), 0L) AS {count}",
        f"{ratio('sum(v * n)', 'sum(CASE WHEN v IS NOT NULL THEN n END)')} AS mean",
        "min(v) AS min", "max(v) AS max"))
    # second moments about the mean: a difference of large sums would lose digits
    centred = _null_safe(table, first.select(*keys, "mean"), keys) if keys else table.withColumn(
        "mean", first.select("mean").scalar())
    spread = centred.groupBy(*keys).agg(F.expr(
        f"sqrt({ratio('sum(n * (v - mean) * (v - mean))', 'sum(CASE WHEN v IS NOT NULL THEN n END) - 1')}) AS std"))
    joined = _null_safe(first, spread, keys) if keys else first.withColumn("std", spread.select("std").scalar())
    return joined.withColumnsRenamed(dict(zip(keys, by, strict=True)))


def _null_safe(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join of two per-group tables on ``by``, NULL groups included."""
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return left.join(renamed, on, "left").drop(*[f"__r_{c}" for c in by])


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, q25, q50, q75, max of non-null values, per group or overall.

    ``value`` is a column name or any SQL expression over the row. Everything is read off one
    table of (group, value, count); making it and counting its rows are jobs of their own.
    """
    by = list(by)
    table = collapsed(df, F.expr(value), by)
    basic, quartiles = _moments(table, by, "count"), quantiles_of(table, QUARTILES, by)
    if by:
        joined = _null_safe(basic, quartiles, by)
    else:
        joined = basic.withColumns({q: quartiles.select(q).scalar() for q in QUARTILES})
    return joined.select(*by, "count", "mean", "std", "min", *QUARTILES, "max")


def compare_distributions(df: DataFrame, value: str, kept: str) -> DataFrame:
    """(statistic, before, after, change) of ``value`` over all rows and over kept rows.

    Rows are tagged with the sides they count for, so both sides share every scan.
    """
    sided = df.selectExpr(
        f"CAST({value} AS DOUBLE) AS v",
        f"explode(CASE WHEN {kept} THEN array('before', 'after') ELSE array('before') END) AS side")
    stats = describe(sided, "v", ["side"]).withColumn("count", F.expr("CAST(count AS DOUBLE)"))
    names = [c for c in stats.columns if c != "side"]
    wide = stats.unpivot("side", names, "statistic", "x").groupBy("statistic").agg(*exprs(*[
        f"max(CASE side WHEN '{s}' THEN x END) AS {s}" for s in ("before", "after")]))
    return wide.withColumn("change", F.expr("after - before"))


def with_share(counts: DataFrame, name: str = "share_pct") -> DataFrame:
    """Add each row's percentage of all counted ``rows``; the grand total is a scalar subquery."""
    total = counts.agg(F.expr("sum(rows) AS total")).scalar()
    return counts.withColumn("__total", total).withColumn(
        name, percent("rows", "__total")).drop("__total")


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(value, rows, share_pct) of non-null values, most frequent first; share of all rows."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.expr(ROWS))
    ranked = (with_share(counts).where("value IS NOT NULL")
              .orderBy(F.desc("rows"), "value"))
    return ranked if top is None else ranked.limit(top)


def class_split(df: DataFrame, member: str, code: str) -> DataFrame:
    """Members (an SQL condition), others, their shares and the number of distinct codes."""
    members = f"count_if({member})"
    return df.agg(
        *exprs(f"{members} AS members", f"count(1) - {members} AS others"),
        percent(members, "count(1)").alias("member_pct"),
        percent(f"(count(1) - {members})", "count(1)").alias("other_pct"),
        F.expr(f"count(DISTINCT {code}) AS distinct_codes"),
    )


def group_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """rows, mean, median, std, min, max of ``value`` by group, largest group first."""
    table = collapsed(df, F.expr(value), [by])
    basic, middle = _moments(table, [by], "rows"), quantiles_of(table, {"median": 0.5}, [by])
    return (_null_safe(basic.where(F.col(by).isNotNull()), middle, [by])
            .select(by, "rows", "mean", "median", "std", "min", "max")
            .orderBy(F.desc("rows"), by))


def quantile_table(df: DataFrame, value: str, by: str | Sequence[str]) -> DataFrame:
    """min, quartiles and max per group: what a box or violin plot draws."""
    keys = [by] if isinstance(by, str) else list(by)
    return exact_quantiles(df, value, {"min": 0.0, **QUARTILES, "max": 1.0}, keys)


def histogram(df: DataFrame, value: str, bins: int, by: str, low: float | None = None) -> DataFrame:
    """Density histogram per group over shared equal-width bins (0-based ``bin``).

    Bins run from ``low`` (default: the minimum) to the maximum; the maximum
    belongs to the last bin and each group's density integrates to one.
    """
    values = df.select(by, F.expr(f"CAST({value} AS DOUBLE) AS v")).where("v IS NOT NULL")
    ends = values.agg(F.expr("min(v) AS lo"), F.expr("max(v) AS hi"))
    edges = {"lo": ends.select("lo").scalar() if low is None else F.lit(float(low)),
             "hi": ends.select("hi").scalar()}
    width = f"((hi - lo) / {bins})"
    cell = f"CAST(coalesce(least(floor({ratio('v - lo', width)}), {bins - 1}), {bins - 1}) AS INT)"
    counts = (
        values.withColumns(edges).where("v >= lo")
        .groupBy(by, "lo", "hi", F.expr(f"{cell} AS bin")).agg(F.expr(ROWS))
    )
    # the density window sees at most ``bins`` rows per group
    return counts.selectExpr(
        by, "bin", f"lo + bin * {width} AS bin_start", "rows",
        f"{ratio('rows', f'(sum(rows) OVER (PARTITION BY {by}) * {width})')} AS density")


# ---- missingness ---------------------------------------------------------


def null_audit(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, nulls, share_pct) for the columns that have nulls, from one scan."""
    columns = df.columns if columns is None else list(columns)
    fields = ", ".join(f"struct('{c}' AS column_name, count_if(`{c}` IS NULL) AS nulls)"
                       for c in columns)
    counted = df.agg(*exprs("count(1) AS total", f"array({fields}) AS audit"))
    return counted.selectExpr("total", "inline(audit)").where("nulls > 0").select(
        "column_name", "nulls", percent("nulls", "total").alias("share_pct"))


def null_audit_by(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Percent of nulls of every column, one row per group."""
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(*[
        percent(f"count_if(`{c}` IS NULL)", "count(1)").alias(f"{c}_null_pct")
        for c in columns
    ])


def feature_health(model_rows: DataFrame,
                   columns: Sequence[str] = FEATURE_GROUPS["lagged"]) -> DataFrame:
    """(feature, null_pct, mean, std) on the given rows; one wide aggregate."""
    fields = ", ".join(
        f"struct('{c}' AS feature, {ratio(f'100D * count_if(`{c}` IS NULL)', 'count(1)')} AS null_pct, "
        f"avg(CAST(`{c}` AS DOUBLE)) AS mean, stddev_samp(CAST(`{c}` AS DOUBLE)) AS std)"
        for c in columns)
    return model_rows.agg(F.expr(f"array({fields}) AS health")).selectExpr("inline(health)")


# ---- coverage and censoring ----------------------------------------------


def coverage_bounds(df: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Observed against expected ends of both clocks, and by how far departures overhang."""
    seen = df.agg(*exprs(
        "min(searchDate) AS search_min", "max(searchDate) AS search_max",
        "min(flightDate) AS flight_min", "max(flightDate) AS flight_max"))
    return seen.selectExpr(
        "search_min", "search_max", f"DATE '{params.search_start}' AS search_min_expected",
        f"DATE '{params.search_end}' AS search_max_expected",
        "flight_min", "flight_max", f"DATE '{params.flight_start}' AS flight_min_expected",
        f"DATE '{params.flight_end}' AS flight_max_expected",
        "datediff(flight_max, search_max) AS overhang_days")


def rows_by_month(df: DataFrame, date_col: str = "flightDate") -> DataFrame:
    """(month, rows, share_pct) of a date column."""
    return with_share(df.groupBy(month_key(date_col).alias("month")).agg(F.expr(ROWS)))


def rows_on(df: DataFrame, day: date, date_col: str = "flightDate") -> DataFrame:
    return df.agg(F.expr(f"count_if(to_date({date_col}) = DATE '{day}') AS rows"))


HORIZON = "datediff(flightDate, searchDate)"


def censoring_by_month(df: DataFrame) -> DataFrame:
    """Rows and the nearest and furthest booking horizon per departure month."""
    return df.groupBy(month_key("flightDate").alias("month")).agg(*exprs(
        f"count({HORIZON}) AS rows", f"min({HORIZON}) AS closest_to_departure",
        f"max({HORIZON}) AS furthest_from_departure"))


def closest_observation(df: DataFrame) -> DataFrame:
    """Per departure date: its rows and its smallest booking horizon."""
    return df.groupBy("flightDate").agg(*exprs(f"min({HORIZON}) AS closest", ROWS))


def censoring_summary(df: DataFrame, censor_days: int = DEFAULTS.censor_days) -> DataFrame:
    """Dates in total, dates never seen within ``censor_days``, share, first such date."""
    far = f"closest > {censor_days}"
    return closest_observation(df).agg(
        *exprs("count(1) AS dates", f"count_if({far}) AS censored_dates"),
        percent(f"count_if({far})", "count(1)").alias("censored_pct"),
        F.expr(f"min(CASE WHEN {far} THEN flightDate END) AS first_censored"))


def cutoff_report(df: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The configured cutoff, the one the data imply, and the rows each retains."""
    # naming both measures in every filter keeps all reads on the same exchange
    per_date = closest_observation(df)
    first_far = per_date.where(f"closest > {params.censor_days} AND rows > 0").agg(
        F.min("flightDate").alias("d")).scalar()
    last_clear = (per_date.where("closest IS NULL OR rows > 0")
                  .where(F.coalesce(F.col("flightDate") < first_far, F.lit(True)))
                  .agg(F.max("flightDate").alias("d")).scalar())
    per_date = per_date.where("closest IS NULL OR rows > 0")
    cutoff = f"DATE '{params.full_trajectory_end}'"
    kept = f"coalesce(sum(CASE WHEN flightDate <= {cutoff} THEN rows END), 0)"
    derived = "coalesce(sum(CASE WHEN flightDate <= edge THEN rows END), 0)"
    return per_date.withColumn("edge", last_clear).agg(
        *exprs(f"{cutoff} AS cutoff", "max(edge) AS derived_cutoff", "sum(rows) AS rows",
               f"{kept} AS retained"),
        percent(kept, "sum(rows)").alias("retained_pct"),
        F.expr(f"{derived} AS derived_retained"))


# ---- daily series --------------------------------------------------------


def daily_mean(df: DataFrame, value: str = "totalFare", date_col: str = "flightDate",
               by: str = "route") -> DataFrame:
    """(date, group, mean): the regular series of a group; one row per calendar day."""
    dated = df.where(F.col(date_col).isNotNull() & F.col(by).isNotNull())
    return dated.groupBy(date_col, by).agg(F.avg(value).alias("mean_fare"))


def crosstab_mean(df: DataFrame, key: str | Column, values: Sequence[str],
                  value: str = "totalFare", by: str = "route") -> DataFrame:
    """Mean of ``value`` by key (rows) and group (one column per listed group).

    The group list is given, so no job is spent on finding it, and the pivot runs
    on the pre-aggregated (key, group) means.
    """
    keyed = df if isinstance(key, str) else df.withColumn("__key", key)
    name = key if isinstance(key, str) else "__key"
    table = keyed.where(F.col(name).isNotNull()).groupBy(name).pivot(by, list(values)).agg(F.avg(value))
    return table.select(F.col(name), *[F.col(f"`{v}`").alias(column_name(v)) for v in values])


def daily_mean_by_route(df: DataFrame, routes: Sequence[str] = DEFAULTS.routes) -> DataFrame:
    return crosstab_mean(df, "flightDate", routes)


def series_lags(df: DataFrame, lags: Sequence[int] = (1, 7, 14)) -> DataFrame:
    """Daily series with its own row-offset lags; a series has one row per date."""
    w = Window.partitionBy("route").orderBy("flightDate")
    series = daily_mean(df).where(F.col("mean_fare").isNotNull())
    return series.withColumns({f"lag{k}": F.lag("mean_fare", k).over(w) for k in lags})


def autocorrelation(df: DataFrame, lags: Sequence[int] = (1, 7, 14)) -> DataFrame:
    """Pearson correlation of each daily series with its lags, and whether weeks dominate."""
    table = series_lags(df, lags).groupBy("route").agg(*[
        F.corr("mean_fare", f"lag{k}").alias(f"lag_{k}") for k in lags])
    if {1, 7} <= set(lags):
        table = table.withColumn("weekly_dominant", F.col("lag_7") > F.col("lag_1"))
    return table


def weekday_profile(df: DataFrame) -> DataFrame:
    """Mean of daily means per weekday and route, with peak, cheapest day and their ratio.

    The extremes are read off one-decimal means; the earlier weekday wins a tie.
    """
    per_day = (
        daily_mean(df).groupBy("route", F.expr("weekday(flightDate) AS d"))
        .agg(F.expr("bround(avg(mean_fare), 1) AS m")).where("m IS NOT NULL")
    )
    names = "array(" + ", ".join(f"'{n}'" for n in DAY_NAMES) + ")"
    wide = per_day.groupBy("route").agg(*exprs(
        *[f"max(CASE d WHEN {i} THEN m END) AS {n}" for i, n in enumerate(DAY_NAMES)],
        "max(struct(m, -d AS d)) AS top", "min(struct(m, d)) AS low"))
    return wide.selectExpr(
        "route", *DAY_NAMES, f"get({names}, -top.d) AS peak_day",
        f"get({names}, low.d) AS cheapest_day", f"{ratio('top.m', 'low.m')} AS peak_to_trough")


# ---- trajectories --------------------------------------------------------


def trajectory_profile(df: DataFrame, group: str = "legId") -> DataFrame:
    """Per trajectory: distinct search dates, rows, and whether it spans departures.

    Collapses to (group, date) before grouping by trajectory, so a huge
    trajectory reaches the second aggregate as one row per date.
    """
    per_date = df.groupBy(group, "searchDate").agg(*exprs(
        "count(1) AS n", "min(flightDate) AS f0", "max(flightDate) AS f1"))
    return per_date.groupBy(group).agg(*exprs(
        "count(searchDate) AS observations", "sum(n) AS rows",
        "min(f0) < max(f1) AS spans_departures"))


def trajectory_contract(df: DataFrame, group: str = "legId") -> DataFrame:
    """Trajectories, recurring ones, ones spanning departures, and duplicate-key rows."""
    recurring = "count_if(observations > 1)"
    return trajectory_profile(df, group).where(F.col(group).isNotNull()).agg(
        *exprs("count(1) AS trajectories", f"{recurring} AS recurring"),
        percent(recurring, "count(1)").alias("recurring_pct"),
        F.expr("count_if(spans_departures) AS spanning_departures"))


def duplicate_keys(df: DataFrame, group: str = "legId", day: str = "searchDate") -> DataFrame:
    """Rows beyond the first for each (trajectory, date)."""
    per_key = df.groupBy(group, day).agg(F.expr("count(1) AS n"))
    return per_key.agg(F.expr("coalesce(sum(n - 1), 0) AS duplicate_rows"))


def length_coverage(df: DataFrame, levels: Sequence[int] = LENGTH_LEVELS,
                    group: str = "legId") -> DataFrame:
    """(observations, flights_with_at_least, share_pct) for each length level."""
    profile = trajectory_profile(df, group).where(F.col(group).isNotNull())
    fields = ", ".join(f"struct({n} AS observations, count_if(observations >= {n}) "
                       "AS flights_with_at_least)" for n in levels)
    counted = profile.agg(*exprs("count(1) AS flights", f"array({fields}) AS levels"))
    return counted.selectExpr("flights", "inline(levels)").select(
        "observations", "flights_with_at_least",
        percent("flights_with_at_least", "flights", empty=0.0).alias("share_pct"))


def gap_counts(df: DataFrame, traj: Trajectory = Trajectory(),
               day: str = "searchDate") -> DataFrame:
    """(gap_days, rows): how often consecutive observations are that many days apart."""
    narrow = df.select(*dict.fromkeys((traj.group, *traj.order, day)))
    gapped = on_trajectories(
        narrow, traj,
        lambda d, t: d.withColumn("gap_days", frames.gap_days(day, t.over())), 1)
    return (gapped.where(F.col("gap_days").isNotNull())
            .groupBy("gap_days").agg(F.expr(ROWS)))


def cadence_table(df: DataFrame, traj: Trajectory = Trajectory(), day: str = "searchDate",
                  top: int = 7) -> DataFrame:
    """The ``top`` smallest gaps with their counts and shares."""
    return with_share(gap_counts(df, traj, day)).orderBy("gap_days").limit(top)


def cadence_summary(df: DataFrame, traj: Trajectory = Trajectory(), day: str = "searchDate",
                    long_gap: int = 7) -> DataFrame:
    """Median and mean gap and the share of gaps longer than ``long_gap`` days.

    Works on the gap histogram, whose rows are bounded by the calendar.
    """
    longer = f"coalesce(sum(CASE WHEN gap_days > {long_gap} THEN rows END), 0)"
    return gap_counts(df, traj, day).agg(
        *exprs("percentile(gap_days, 0.5D, rows) AS median_gap",
               "sum(gap_days * rows) / sum(rows) AS mean_gap", f"{longer} AS long_gaps"),
        percent(longer, "sum(rows)").alias("long_gap_pct"))


def fare_changes(df: DataFrame, traj: Trajectory = Trajectory(),
                 value: str = "totalFare") -> DataFrame:
    """(trajectory, fare_change) between consecutive observations; first rows are left out."""
    narrow = df.select(*dict.fromkeys((traj.group, *traj.order, value)))
    moved = on_trajectories(
        narrow, traj,
        lambda d, t: d.withColumn("fare_change", frames.change(value, t.over())), 1)
    return moved.where(F.col("fare_change").isNotNull()).select(traj.group, "fare_change")


def step_profile(df: DataFrame, traj: Trajectory = Trajectory(),
                 value: str = "totalFare") -> DataFrame:
    """How often consecutive fares repeat, and the median number of distinct fares."""
    same = "count_if(fare_change = 0)"
    distinct = (df.where(F.col(value).isNotNull()).groupBy(traj.group, value).agg(F.lit(1))
                .groupBy(traj.group).agg(F.expr("count(1) AS n")))
    middle = exact_quantiles(distinct, "n", {"m": 0.5}).select("m").scalar()
    return fare_changes(df, traj, value).agg(
        *exprs(f"{same} AS unchanged", "count(1) AS compared"),
        percent(same, "count(1)").alias("unchanged_pct"),
    ).withColumn("median_distinct_fares", middle)


def change_sizes(df: DataFrame, traj: Trajectory = Trajectory(),
                 value: str = "totalFare") -> DataFrame:
    """Distribution of the absolute size of fare changes that are not zero."""
    moved = fare_changes(df, traj, value).where(F.col("fare_change") != 0)
    return describe(moved, "abs(fare_change)")


def first_per_trajectory(df: DataFrame, column: str, traj: Trajectory = Trajectory()) -> DataFrame:
    """Earliest non-null ``column`` of each trajectory; an aggregate, so it combines map-side."""
    present = df.where(F.col(column).isNotNull())
    return present.groupBy(traj.group).agg(
        F.min_by(column, F.struct(*traj.order)).alias(column))


def long_trajectories(df: DataFrame, at_least: int = 40, group: str = "legId") -> DataFrame:
    """Keys of trajectories with at least that many search dates."""
    return trajectory_profile(df, group).where(F.col("observations") >= at_least).select(group)


def keep_groups(df: DataFrame, keys: DataFrame, group: str = "legId") -> DataFrame:
    """Semi join on a key set; AQE broadcasts the keys only when their measured size is small."""
    return df.join(keys.select(group), group, "left_semi")


def sample_trajectories(df: DataFrame, seed: int = DEFAULTS.seed, by: str = "route",
                        group: str = "legId") -> DataFrame:
    """One pseudo-random trajectory per group: the one whose key and seed have the smallest MD5."""
    draw = F.md5(F.concat_ws("#", F.col(group).cast("string"), F.lit(seed)))
    distinct = df.where(F.col(by).isNotNull()).select(by, group).distinct()
    return distinct.groupBy(by).agg(
        F.min(F.struct(draw.alias("draw"), F.col(group).alias("g"))).alias("first")
    ).select(by, F.col("first.g").alias(group))


def trajectory_extract(df: DataFrame, key: object, traj: Trajectory = Trajectory()) -> DataFrame:
    """One trajectory, furthest horizon first."""
    return df.where(F.col(traj.group) == key).orderBy(
        F.desc("daysBeforeDeparture"), *traj.order)


# ---- spikes and fares by context -----------------------------------------


def booking_curve(df: DataFrame, routes: Sequence[str] = DEFAULTS.routes) -> DataFrame:
    """Mean fare by horizon bin and route, plus the percent rise into departure."""
    days = "daysBeforeDeparture"
    binned = (df.withColumns({"horizon": horizon_bin(days), "horizon_rank": horizon_rank(days)})
              .where(F.col("horizon").isNotNull()))
    table = binned.groupBy("horizon", "horizon_rank").pivot("route", list(routes)).agg(
        F.avg("totalFare"))
    names = [column_name(r) for r in routes]
    table = table.select("horizon", "horizon_rank",
                         *[F.col(f"`{r}`").alias(n) for r, n in zip(routes, names, strict=True)])
    near, far = HORIZON_LABELS[0], HORIZON_LABELS[-1]

    def at(label: str, name: str) -> str:
        return f"max(CASE horizon WHEN '{label}' THEN {name} END)"

    rise = table.agg(*exprs(*[
        f"({ratio(at(near, n), at(far, n))} - 1) * 100 AS {n}" for n in names
    ])).selectExpr(f"'rise {far} -> {near} (%)' AS horizon",
                   f"{len(HORIZON_LABELS)} AS horizon_rank", *names)
    return table.unionByName(rise)


def horizon_fare_correlation(df: DataFrame) -> DataFrame:
    return df.agg(F.corr("daysBeforeDeparture", "totalFare").alias("correlation"))


def horizon_event_rate(labelled: DataFrame) -> DataFrame:
    """Labelable rows, events and event rate per horizon bin."""
    days = "daysBeforeDeparture"
    return (
        labelled.where("isLabelable")
        .groupBy(horizon_bin(days).alias("horizon"), horizon_rank(days).alias("horizon_rank"))
        .agg(*exprs("count(1) AS labelable", "count_if(isSpikeEvent) AS events"),
             percent("count_if(isSpikeEvent)", "count(1)").alias("event_rate_pct"))
        .where("horizon IS NOT NULL")
    )


def class_balance(labelled: DataFrame) -> DataFrame:
    """Events, other labelable rows and their ratio."""
    counts = labelled.agg(*exprs("count_if(isLabelable) AS labelable",
                                 "count_if(isSpikeEvent) AS minority"))
    return counts.selectExpr("labelable", "minority", "labelable - minority AS majority",
                             f"{ratio('labelable - minority', 'minority')} AS imbalance_ratio")


def minority_by(labelled: DataFrame, by: str = "route") -> DataFrame:
    return labelled.where("isLabelable").where(F.col(by).isNotNull()).groupBy(by).agg(
        F.expr("count_if(isSpikeEvent) AS minority"))


def airline_summary(features: DataFrame) -> DataFrame:
    """Rows, mean and median fare, spike rate and share per first carrier, largest first."""
    key = f"{GROUP}0"
    table = collapsed(features, F.col("totalFare"), ["airline"],
                      {"events": F.expr("CAST(isSpikeEvent AS BIGINT)")})
    counts = table.groupBy(F.col(key).alias("airline")).agg(
        *exprs("sum(n) AS rows",
               f"{ratio('sum(v * n)', 'sum(CASE WHEN v IS NOT NULL THEN n END)')} AS mean_fare"),
        percent("coalesce(sum(events), 0)", "sum(n)").alias("spike_rate"))
    basic, middle = with_share(counts), quantiles_of(table, {"median_fare": 0.5}, ["airline"])
    return (
        _null_safe(basic.where(F.col("airline").isNotNull()), middle, ["airline"])
        .select("airline", "rows", "mean_fare", "median_fare", "spike_rate", "share_pct")
        .orderBy(F.desc("rows"), "airline")
    )


def near_holiday(features: DataFrame, band: int = DEFAULTS.holiday_band) -> DataFrame:
    return features.where(F.col("daysToNearestHoliday").between(-band, band))


def counters(labelled: DataFrame, group: str = "legId") -> DataFrame:
    """Rows, labelable rows, events and distinct trajectories."""
    return labelled.agg(*exprs(
        ROWS, "count_if(isLabelable) AS labelable", "count_if(isSpikeEvent) AS events",
        f"count(DISTINCT {group}) AS trajectories"))
