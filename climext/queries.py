"""One query for each operator over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Periodicity
from .functions.special import norm_cdf_sql, norm_ppf, norm_ppf_sql, standardize
from .operators import calendar, classify, fit, grid, index, pet, runs, views
from .plans import frames, planning

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CAL = {"start": 1995, "end": 2001}

# ---------------------------------------------------------------- SQL building blocks

M = """s AS (SELECT l_suppkey AS cell_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS time, sum(l_quantity) AS value,
  sum(round(l_quantity * l_discount, 2) * 8) AS pet, avg(l_quantity) - 10 AS tmean, min(l_quantity) - 20 AS tmin,
  max(l_quantity) AS tmax FROM lineitem GROUP BY 1, 2),
cal AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS DATE) AS time),
m AS (SELECT c.s_suppkey AS cell_id, cal.time, s.value, s.pet, s.tmean, s.tmin, s.tmax,
  CAST(((c.s_suppkey % 25) - 12) * 5 AS DOUBLE) AS lat
  FROM supplier c CROSS JOIN cal LEFT JOIN s ON s.cell_id = c.s_suppkey AND s.time = cal.time)"""
R = M.replace("FROM lineitem GROUP", "FROM lineitem WHERE l_returnflag = 'R' GROUP").replace("s.value, s.pet", "coalesce(s.value, 0) AS value, s.pet")
#: Forty years: the order's number stands for the month, a twentieth of the suppliers' numbers for the cell.
LM = """s AS (SELECT l_suppkey % 50 AS cell_id, CAST(DATE '1960-01-01' + to_months(CAST(l_orderkey % 480 AS INT)) AS DATE) AS time,
  sum(l_quantity) AS value, sum(round(l_quantity * l_discount, 2) * 8) AS pet FROM lineitem GROUP BY 1, 2),
cal AS (SELECT CAST(unnest(generate_series(DATE '1960-01-01', DATE '1999-12-01', INTERVAL 1 MONTH)) AS DATE) AS time),
m AS (SELECT c.cell_id, cal.time, coalesce(s.value, 0) AS value, coalesce(s.pet, 0) AS pet
  FROM (SELECT DISTINCT cell_id FROM s) c CROSS JOIN cal LEFT JOIN s ON s.cell_id = c.cell_id AND s.time = cal.time)"""
LONG_CAL = {"start": 1961, "end": 1995}
Z = (
    M
    + """,
z AS (SELECT cell_id, time, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS value
  FROM m WINDOW w AS (PARTITION BY cell_id))"""
)


def _rolled(table: str, value: str, *scales: int) -> str:
    cols = ", ".join(
        f"CASE WHEN count({value}) OVER w{s} = {s} THEN sum({value}) OVER w{s} END AS v{s}" for s in scales
    )
    wins = ", ".join(f"w{s} AS (PARTITION BY cell_id ORDER BY time ROWS BETWEEN {s - 1} PRECEDING AND CURRENT ROW)" for s in scales)
    return f"SELECT *, {cols} FROM {table} WINDOW {wins}"


def _thom(table: str, v: str, where: str = "true") -> str:
    a = f"(ln(avg({v}) FILTER ({v} > 0)) - avg(ln({v})) FILTER ({v} > 0))"
    return f"""SELECT cell_id, month(time) AS period, CAST(count({v}) FILTER ({v} = 0) AS DOUBLE) / nullif(count({v}), 0) AS q,
  CASE WHEN count({v}) FILTER ({v} > 0) >= 4 AND {a} > 0 THEN (1 + sqrt(1 + 4 * {a} / 3)) / (4 * {a}) END AS alpha,
  avg({v}) FILTER ({v} > 0) AS mu FROM {table} WHERE {where} GROUP BY 1, 2"""


def _gamma_p(a: str, x: str) -> str:
    """Regularised incomplete gamma function: the terms within eight deviations of the greatest one."""
    low = f"CAST(greatest(0, floor({x} - {a} - 8 * sqrt({x}) - 30)) AS BIGINT)"
    high = f"CAST(greatest(0, {x} - {a}) + 8 * sqrt(greatest({a}, {x})) + 50 AS BIGINT)"
    return f"list_sum(list_transform(range({low}, {high}), lambda n: exp(({a} + n) * ln({x}) - {x} - lgamma({a} + n + 1))))"


def _clip(p: str) -> str:
    return f"greatest(-3.09, least(3.09, {norm_ppf_sql(p)}))"


def _index(v: str) -> str:
    """Index value from v, alpha, mu, q of one row."""
    p = f"CASE WHEN {v} > 0 THEN {_gamma_p('alpha', f'({v} / (mu / alpha))')} ELSE 0 END"
    return f"CASE WHEN alpha IS NOT NULL AND {v} IS NOT NULL THEN greatest(1e-10, least(1 - 1e-10, q + (1 - q) * ({p}))) END"


def _islands(table: str, test: str, keys: str = "cell_id") -> str:
    """Runs by the difference of two row numbers."""
    return f"""SELECT *, idx - row_number() OVER (PARTITION BY {keys}, hit ORDER BY time) AS g FROM (
  SELECT *, coalesce({test}, false) AS hit, row_number() OVER (PARTITION BY {keys} ORDER BY time) - 1 AS idx FROM {table})"""


def _run_rows(threshold: float, keys: str = "cell_id") -> str:
    peak = "min(struct_pack(v := value, i := idx))" if threshold < 0 else "max(struct_pack(v := value, i := -idx))"
    return f"""SELECT {keys}, min(idx) AS start_idx, max(idx) AS end_idx, min(time) AS start_date, max(time) AS end_date,
  count(*) AS duration, sum(abs(value - ({threshold}))) AS magnitude, {peak} AS p FROM i WHERE hit GROUP BY {keys}, g"""


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _r(digits: int = 6, **cols: str) -> str:
    return ", ".join(f"CAST(round({sql}, {digits}) + 0.0 AS DOUBLE) AS {name}" for name, sql in cols.items())


def query(name: str, sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = lambda spark, d: _rounded(f(spark, d), digits)
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


# ---------------------------------------------------------------- windows, index pipelines


@query("win1_rolling_sum", f"WITH {M}, t AS ({_rolled('m', 'value', 3, 12)}) SELECT cell_id, time, {_r(sum_3='v3', sum_12='v12')} FROM t")
def win1(spark, d):
    df = index.rolling_sum(views.monthly(spark, d), 3, out="sum_3")
    return index.rolling_sum(df, 12, out="sum_12").select("cell_id", "time", "sum_3", "sum_12")


@query(
    "agg1_gamma_params",
    f"WITH {M}, t AS ({_rolled('m', 'value', 3)}), p AS ({_thom('t', 'v3')}) "
    f"SELECT cell_id, CAST(period AS INT) AS period, {_r(alpha='alpha', beta='mu / alpha', prob_zero='q')} FROM p",
)
def agg1(spark, d):
    return index.gamma_params(index.rolling_sum(views.monthly(spark, d), 3), **CAL)


def _spi_sql(base: str, scales: tuple[int, ...], value: str = "value", name: str = "spi") -> str:
    body = f"WITH {base}, t AS ({_rolled('m', value, *scales)})"
    out, join = [], ""
    for s in scales:
        body += f", p{s} AS ({_thom('t', f'v{s}')}), h{s} AS (SELECT t.cell_id, t.time, {_index(f'v{s}')} AS h FROM t LEFT JOIN p{s} p ON p.cell_id = t.cell_id AND p.period = month(t.time))"
        out.append(f"CAST(round({_clip(f'h{s}.h')}, 4) + 0.0 AS DOUBLE) AS {name}_gamma_{s}_month")
        join += f" JOIN h{s} ON h{s}.cell_id = t.cell_id AND h{s}.time = t.time"
    return f"{body} SELECT t.cell_id, t.time, {', '.join(f'CASE WHEN h{s}.h IS NULL THEN NULL ELSE {o.rpartition(chr(32) + 'AS ')[0]} END AS {name}_gamma_{s}_month' for s, o in zip(scales, out, strict=True))} FROM t{join}"


@query("idx7_spi_gamma_3", _spi_sql(M, (3,)), 4)
def idx7(spark, d):
    return index.spi(views.monthly(spark, d), 3, **CAL).select("cell_id", "time", "spi_gamma_3_month")


@query("idx1_spi_zero_inflated", _spi_sql(R, (1,)), 4)
def idx1(spark, d):
    df = views.monthly(spark, d, returned_only=True, fill=0.0)
    return index.spi(df, 1, **CAL).select("cell_id", "time", "spi_gamma_1_month")


@query("idx2_spi_multi_scale", _spi_sql(M, (1, 3, 6)), 4)
def idx2(spark, d):
    return index.spi(views.monthly(spark, d), [1, 3, 6], **CAL).select(
        "cell_id", "time", *(f"spi_gamma_{s}_month" for s in (1, 3, 6))
    )


@query("idx3_spei_gamma", _spi_sql(M.replace("s.value, s.pet", "s.value - s.pet + 1000 AS value, s.pet"), (3,), name="spei"), 4)
def idx3(spark, d):
    df = views.monthly(spark, d)
    return index.spei(df.select("cell_id", "time", "value"), 3, "value", pet=df.select("cell_id", "time", "pet"), **CAL).select(
        "cell_id", "time", "spei_gamma_3_month"
    )


@query("idx4_spei_multi_scale", digits=4)
def idx4(spark, d):
    df = views.monthly(spark, d)
    return index.spei(df, [1, 3, 6], "value", temperature="tmean", latitude="lat", **CAL).select(
        "cell_id", "time", *(f"spei_gamma_{s}_month" for s in (1, 3, 6))
    )


@query(
    "idx9_apply_params",
    f"WITH {M}, t AS ({_rolled('m', 'value', 3)}), p AS ({_thom('t', 'v3', 'year(time) <= 1999')}), "
    f"h AS (SELECT t.cell_id, t.time, {_index('v3')} AS h FROM t LEFT JOIN p ON p.cell_id = t.cell_id AND p.period = month(t.time)) "
    f"SELECT cell_id, time, CASE WHEN h IS NULL THEN NULL ELSE CAST(round({_clip('h')}, 4) + 0.0 AS DOUBLE) END AS spi_gamma_3_month FROM h",
    4,
)
def idx9(spark, d):
    df = views.monthly(spark, d)
    params = index.fit_index_params(df, "value", [3], start=1995, end=1999)
    return index.spi(df, 3, params=params).select("cell_id", "time", "spi_gamma_3_month")


@query("jn1_water_balance", f"WITH {M} SELECT cell_id, time, {_r(balance='value - pet + 1000')} FROM m")
def jn1(spark, d):
    df = views.monthly(spark, d)
    return df.select("cell_id", "time", index.water_balance(F.col("value"), F.col("pet")).alias("balance"))


# ---------------------------------------------------------------- run theory

_EVENT_COLS = (
    "cell_id, CAST(start_idx AS INT) AS start_idx, CAST(end_idx AS INT) AS end_idx, start_date, end_date, duration, "
    + _r(magnitude="magnitude", intensity="magnitude / duration", peak="p.v")
    + ", CAST(abs(p.i) AS INT) AS peak_idx, CAST(start_date + to_months(CAST(abs(p.i) - start_idx AS INT)) AS DATE) AS peak_date"
)


@query("win3_runs_dry", f"WITH {Z}, i AS ({_islands('z', 'value < -1')}), r AS ({_run_rows(-1)}) SELECT {_EVENT_COLS} FROM r")
def win3_dry(spark, d):
    return runs.runs(views.scores(spark, d), -1.0)


@query("win3_runs_wet", f"WITH {Z}, i AS ({_islands('z', 'value > 0.8')}), r AS ({_run_rows(0.8)}) SELECT {_EVENT_COLS} FROM r")
def win3_wet(spark, d):
    return runs.runs(views.scores(spark, d), 0.8, below=False)


@query(
    "win5_events",
    f"WITH {Z}, i AS ({_islands('z', 'value < -0.5')}), r AS ({_run_rows(-0.5)}) SELECT {_EVENT_COLS}, "
    "CAST(row_number() OVER w AS INT) AS event_id, CAST(lead(start_idx) OVER w - start_idx AS INT) AS interarrival "
    "FROM r WHERE duration >= 2 WINDOW w AS (PARTITION BY cell_id ORDER BY start_idx)",
)
def win5(spark, d):
    return runs.identify_events(views.scores(spark, d), -0.5, 2)


@query(
    "win6_monitoring",
    f"""WITH {Z}, i AS ({_islands('z', 'value < -0.5')}),
    a AS (SELECT *, count(*) FILTER (value IS NULL) OVER (PARTITION BY cell_id ORDER BY time) AS seg FROM i),
    b AS (SELECT *, min(time) FILTER (hit) OVER (PARTITION BY cell_id, seg) AS first_hit,
      count(*) OVER e AS d, sum(abs(value + 0.5)) OVER e AS mg, min(value) OVER e AS pk FROM a
      WINDOW e AS (PARTITION BY cell_id, hit, g ORDER BY time)),
    c AS (SELECT *, 1 + count(*) FILTER (NOT hit AND value IS NOT NULL AND time > first_hit)
      OVER (PARTITION BY cell_id, seg ORDER BY time) AS id,
      count(*) FILTER (hit AND d = 1) OVER (PARTITION BY cell_id ORDER BY time) AS seq FROM b)
    SELECT cell_id, time, {_r(index_value='value')}, hit AS is_event, CASE WHEN hit THEN id ELSE 0 END AS event_id,
      CASE WHEN hit THEN d ELSE 0 END AS duration, {_r(
        magnitude_cumulative="CASE WHEN hit THEN mg ELSE 0 END",
        magnitude_instantaneous="CASE WHEN hit THEN abs(value + 0.5) ELSE 0 END",
        intensity="CASE WHEN hit THEN mg / d ELSE 0 END",
        peak_so_far="CASE WHEN hit THEN pk ELSE 0 END",
        deviation="CASE WHEN hit THEN abs(value + 0.5) ELSE 0 END")}, CASE WHEN hit THEN seq END AS run_seq FROM c""",
)
def win6(spark, d):
    return runs.monitor(views.scores(spark, d), -0.5)


@query(
    "win7_event_state",
    f"""WITH {Z} SELECT cell_id, time, coalesce(value < -1, false) AS is_event,
    CASE WHEN value IS NULL THEN 'No Data' WHEN value >= -1 THEN 'No Event' WHEN value >= -1.5 THEN 'Moderate Drought'
      WHEN value >= -2 THEN 'Severe Drought' ELSE 'Extreme Drought' END AS category,
    {_r(deviation="CASE WHEN value < -1 THEN abs(value + 1) ELSE 0 END")} FROM z""",
)
def win7(spark, d):
    return views.scores(spark, d).select("cell_id", "time", runs.event_state(F.col("value"), -1.0).alias("s")).select(
        "cell_id", "time", "s.*"
    )


_COUNTED = "count(*) FILTER (ok) AS num_events"
_BY_CELL = "e AS (SELECT {k}, count(*) AS n, hit AND count(*) >= 2 AS ok, sum(abs(value + 0.5)) AS mg, min(value) AS pk FROM i GROUP BY {k}, hit, g)"


@query(
    "agg6_spatial_events",
    f"WITH {Z}, i AS ({_islands('z', 'value < -0.5')}), {_BY_CELL.format(k='cell_id')} SELECT cell_id, {_COUNTED}, max(n) FILTER (ok) AS max_duration, "
    + _r(
        mean_duration="avg(n) FILTER (ok)", mean_magnitude="avg(mg) FILTER (ok)", max_magnitude="max(mg) FILTER (ok)",
        mean_intensity="avg(mg / n) FILTER (ok)", max_intensity="max(mg / n) FILTER (ok)", mean_peak="avg(pk) FILTER (ok)",
        min_peak="min(pk) FILTER (ok)", extreme_peak="min(pk) FILTER (ok)",
    )
    + " FROM e GROUP BY cell_id",
)
def agg6(spark, d):
    return runs.spatial_events(views.scores(spark, d), -0.5, 2)


def _stats_sql(base: str, keys: str) -> str:
    months = "coalesce(sum(n) FILTER (ok), 0)"
    cols = _r(
        total_magnitude="coalesce(sum(mg) FILTER (ok), 0)", mean_magnitude="avg(mg) FILTER (ok)", max_magnitude="max(mg) FILTER (ok)",
        worst_peak="min(pk) FILTER (ok)", mean_intensity="avg(mg / n) FILTER (ok)", max_intensity="max(mg / n) FILTER (ok)",
        pct_time_in_event=f"100.0 * {months} / sum(n)", extreme_peak="min(pk) FILTER (ok)",
    )
    return f"""WITH {Z}, y AS ({base}), i AS ({_islands('y', 'value < -0.5', keys)}), {_BY_CELL.format(k=keys)}
    SELECT {keys}, {_COUNTED}, CAST({months} AS BIGINT) AS total_event_months, {cols} FROM e GROUP BY {keys}"""


@query("agg7_period_stats", _stats_sql("SELECT * FROM z WHERE year(time) BETWEEN 1996 AND 1999", "cell_id"))
def agg7(spark, d):
    return runs.period_statistics(views.scores(spark, d), -0.5, 1996, 1999, 2)


@query("agg8_annual_stats", _stats_sql("SELECT *, CAST(year(time) AS INT) AS year FROM z", "cell_id, year"))
def agg8(spark, d):
    return runs.annual_statistics(views.scores(spark, d), -0.5, 2)


_PERIODS = "(VALUES ('1995-1998', 1995, 1998), ('1997-2001', 1997, 2001)) AS p(period, a, b)"
_COMPARE = _stats_sql(f"SELECT z.*, p.period FROM z JOIN {_PERIODS} ON year(time) BETWEEN a AND b", "cell_id, period")


@query("agg9_compare_periods", _COMPARE)
def agg9(spark, d):
    return runs.compare_periods(views.scores(spark, d), [(1995, 1998), (1997, 2001)], -0.5, 2)


@query(
    "jn7_period_diff",
    f"WITH q AS ({_COMPARE}) SELECT a.cell_id, {_r(total_magnitude_change='a.total_magnitude - b.total_magnitude')} "
    "FROM q a JOIN q b ON a.cell_id = b.cell_id AND a.period = '1997-2001' AND b.period = '1995-1998'",
)
def jn7(spark, d):
    return runs.period_difference(_rounded(agg9(spark, d)), "1997-2001", "1995-1998", "total_magnitude")


@query(
    "agg10_summary",
    f"WITH {Z}, i AS ({_islands('z', 'value < -0.5')}), r AS ({_run_rows(-0.5)}), "
    "v AS (SELECT *, magnitude / duration AS intensity, lead(start_idx) OVER (PARTITION BY cell_id ORDER BY start_idx) - start_idx AS ia FROM r) "
    "SELECT cell_id, count(*) AS num_events, max(duration) AS max_duration, CAST(sum(duration) AS BIGINT) AS total_event_months, "
    + _r(
        mean_duration="avg(duration)", median_duration="median(duration)", mean_magnitude="avg(magnitude)", max_magnitude="max(magnitude)",
        mean_intensity="avg(intensity)", max_intensity="max(intensity)", mean_peak="avg(p.v)", most_severe_peak="min(p.v)",
        mean_interarrival="avg(ia)",
    )
    + " FROM v GROUP BY cell_id",
)
def agg10(spark, d):
    return runs.summarize_events(runs.identify_events(views.scores(spark, d), -0.5), ["cell_id"])


@query("agg11_dry_area", f"WITH {Z} SELECT time, {_r(area_percentage='100.0 * count(*) FILTER (value <= -1) / nullif(count(value), 0)')} FROM z GROUP BY time")
def agg11(spark, d):
    return classify.area_percentage(views.scores(spark, d), -1.0)


@query("agg12_wet_area", f"WITH {Z} SELECT time, {_r(area_percentage='100.0 * count(*) FILTER (value >= 1) / count(*)')} FROM z GROUP BY time")
def agg12(spark, d):
    return classify.wet_area_percentage(views.scores(spark, d), 1.0)


@query(
    "agg13_completeness",
    f"WITH {M}, c AS (SELECT cell_id, count(value) AS v, count(*) AS n FROM m GROUP BY 1) SELECT count(*) AS total_cells, "
    "count(*) FILTER (v > 0) AS land_cells, count(*) FILTER (v = 0) AS ocean_cells, max(n) AS total_timesteps, "
    "count(*) FILTER (v > 0 AND v = n) AS fully_complete_land_cells, "
    + _r(
        land_fraction="100.0 * count(*) FILTER (v > 0) / count(*)", mean_temporal_completeness="avg(100.0 * v / n) FILTER (v > 0)",
        min_temporal_completeness="min(100.0 * v / n) FILTER (v > 0)", max_temporal_completeness="max(100.0 * v / n) FILTER (v > 0)",
    )
    + " FROM c",
)
def agg13(spark, d):
    return grid.completeness(views.monthly(spark, d))


@query("agg2_zero_counts", f"WITH {R} SELECT cell_id, count(*) FILTER (value = 0) AS zeros, count(value) AS non_missing FROM m GROUP BY 1")
def agg2(spark, d):
    return grid.zero_counts(views.monthly(spark, d, returned_only=True, fill=0.0))


@query("agg15_regional_mean", f"WITH {M} SELECT time, {_r(regional_mean='avg(value)')} FROM m GROUP BY time")
def agg15(spark, d):
    return classify.regional_mean(views.monthly(spark, d))


@query(
    "agg16_corr",
    f"WITH {M} SELECT count(*) AS n, {_r(correlation='corr(value, pet)', max_abs_diff='max(abs(value - pet))', mean_abs_diff='avg(abs(value - pet))')} "
    "FROM m WHERE value IS NOT NULL AND pet IS NOT NULL",
)
def agg16(spark, d):
    return classify.compare_columns(views.monthly(spark, d), "value", "pet")


@query("src4_year_range", f"WITH {M} SELECT CAST(min(year(time)) AS INT) AS start_year, CAST(max(year(time)) AS INT) AS end_year FROM m")
def src4(spark, d):
    return grid.year_range(views.monthly(spark, d))


@query(
    "cls1_mckee",
    f"""WITH {Z} SELECT cell_id, time, CAST(CASE WHEN value >= 2 THEN 4 WHEN value >= 1.5 THEN 3 WHEN value >= 1 THEN 2 WHEN value > -1 THEN 1
    WHEN value > -1.5 THEN 0 WHEN value > -2 THEN -1 WHEN value <= -2 THEN -2 END AS INT) AS category FROM z""",
)
def cls1(spark, d):
    return views.scores(spark, d).select("cell_id", "time", classify.mckee_class(F.col("value")).alias("category"))


@query(
    "cls2_11class",
    f"""WITH {Z}, k AS (SELECT * FROM (VALUES (1, -2.0, 'exceptionally_dry'), (2, -1.5, 'extremely_dry'), (3, -1.2, 'severely_dry'),
    (4, -0.7, 'moderately_dry'), (5, -0.5, 'abnormally_dry'), (6, 0.5, 'near_normal'), (7, 0.7, 'abnormally_moist'), (8, 1.2, 'moderately_moist'),
    (9, 1.5, 'very_moist'), (10, 2.0, 'extremely_moist'), (11, 99.0, 'exceptionally_moist')) AS t(i, top, name))
    SELECT cell_id, time, (SELECT arg_min(name, i) FROM k WHERE z.value <= top) AS class FROM z""",
)
def cls2(spark, d):
    return views.scores(spark, d).select("cell_id", "time", classify.eleven_class(F.col("value")).alias("class"))


_TIMELINE = ORACLES["win6_monitoring"]
for _shown in ("d", "mg", "mg / d", "pk"):
    _TIMELINE = _TIMELINE.replace(f"CASE WHEN hit THEN {_shown} ELSE 0 END", f"CASE WHEN hit THEN {_shown} END")


@query("vis4_event_timeline", _TIMELINE)
def vis4(spark, d):
    return frames.event_timeline(views.scores(spark, d), -0.5)


# ---------------------------------------------------------------- distribution toolkit: the pooled months of each supplier


def _sample_sql(keys: str) -> str:
    """CTEs k, st0, st: statistics of the samples of v (keys, x)."""
    return f"""k AS (SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY x) - 1 AS DOUBLE) AS i, CAST(count(*) OVER c AS DOUBLE) AS cn,
  avg(x) OVER c AS mu FROM v WINDOW c AS (PARTITION BY {keys})),
st0 AS (SELECT {keys}, count(*) AS n, avg(x) AS l1, var_samp(x) AS var, avg((x - mu) ** 3) AS m3, min(x) AS lo, max(x) AS hi,
  avg(x * i / (cn - 1)) AS b1, avg(x * i * (i - 1) / ((cn - 1) * (cn - 2))) AS b2,
  avg(x * i * (i - 1) * (i - 2) / ((cn - 1) * (cn - 2) * (cn - 3))) AS b3, count(*) FILTER (x <= 0) AS nz FROM k GROUP BY {keys}),
st AS (SELECT *, CAST(nz AS DOUBLE) / n AS q, 2 * b1 - l1 AS l2, 6 * b2 - 6 * b1 + l1 AS l3, 20 * b3 - 30 * b2 + 12 * b1 - l1 AS l4,
  sqrt(var) AS sd FROM st0)"""


ST = M + ", v AS (SELECT cell_id, value AS x FROM m WHERE value IS NOT NULL), " + _sample_sql("cell_id")
_K = ["cell_id"]


def _pool(spark, d) -> DataFrame:
    return views.monthly(spark, d).select("cell_id", "time", "value")


@query("agg4_lmoments", f"WITH {ST} SELECT cell_id, {_r(l1='l1', l2='l2', l3='l3', l4='l4')} FROM st")
def agg4(spark, d):
    return fit.lmoments(_pool(spark, d), _K, "value")


@query("agg5_lmoment_ratios", f"WITH {ST} SELECT cell_id, {_r(l1='l1', l2='l2', l3='l3', l4='l4', t2='l2 / l1', t3='l3 / l2', t4='l4 / l2')} FROM st")
def agg5(spark, d):
    return fit.lmoment_ratios(agg4(spark, d))


_FIT = {
    "dst1a_gamma_moments": ("gamma", "moments", {"alpha": "least(1000, l1 * l1 / var)", "beta": "var / l1"}),
    "dst1b_gamma_lmoments": ("gamma", "lmoments", {
        "alpha": "least(1000, (1 + 0.2906 * pi() * (l2 / l1) ** 2) / (pi() * (l2 / l1) ** 2 + 0.0552 * (pi() * (l2 / l1) ** 2) ** 2))",
        "beta": "l1 / least(1000, (1 + 0.2906 * pi() * (l2 / l1) ** 2) / (pi() * (l2 / l1) ** 2 + 0.0552 * (pi() * (l2 / l1) ** 2) ** 2))"}),
    "dst3a_pearson3_moments": ("pearson3", "moments", {
        "skew": "m3 / sd ** 3 * sqrt(n * (n - 1)) / (n - 2)", "loc": "l1", "scale": "sd"}),
    "dst3b_pearson3_lmoments": ("pearson3", "lmoments", {
        "skew": "sk", "loc": "l1 - al * (l2 * sqrt(pi()) * CASE WHEN al < 170 AND gamma(al + 0.5) > 1e-10 THEN sqrt(al) / gamma(al + 0.5) ELSE 1 END) * sign(sk)",
        "scale": "greatest(1e-10, l2 * sqrt(pi()) * CASE WHEN al < 170 AND gamma(al + 0.5) > 1e-10 THEN sqrt(al) / gamma(al + 0.5) ELSE 1 END)"}),
    "dst5b_log_logistic_moments": ("log_logistic", "moments", {"alpha": "a1", "beta": "l1 * sin(pi() / a1) / (pi() / a1)"}),
    "dst5c_log_logistic_lmoments": ("log_logistic", "lmoments", {"alpha": "a2", "beta": "l1 * sin(pi() / a2) / (pi() / a2)"}),
    "dst7a_gev_lmoments": ("gev", "lmoments", {
        "shape": "gk", "scale": "l2 * gk / (gamma(1 + gk) * (1 - 2 ** (-gk)))",
        "loc": "l1 - l2 * gk / (gamma(1 + gk) * (1 - 2 ** (-gk))) * (gamma(1 + gk) - 1) / gk"}),
    "dst9a_gen_logistic_lmoments": ("gen_logistic", "lmoments", {
        "shape": "lk", "scale": "l2 * sin(pi() * lk) / (pi() * lk)",
        "loc": "l1 - l2 * sin(pi() * lk) / (pi() * lk) * (1 / lk - pi() / sin(pi() * lk))"}),
}
#: Helpers of the fits by L-moments, from the statistics.
_FT = """,
ft AS (SELECT *, greatest(2.1, pi() / (sd / l1 * sqrt(3))) AS a1, greatest(2.1, pi() / asin(l2 / l1)) AS a2,
  least(1000, 4 / (sk * sk)) AS al FROM (SELECT *, 2 * l3 / l2 * (1 + 0.2906 * (l3 / l2) ** 2) AS sk,
  greatest(-0.5, least(0.5, 7.8590 * (2 / (3 + l3 / l2) - ln(2) / ln(3)) + 2.9554 * (2 / (3 + l3 / l2) - ln(2) / ln(3)) ** 2)) AS gk,
  greatest(-0.5, least(0.5, -l3 / l2)) AS lk FROM st))"""
FT = ST + _FT


def _fits(name: str) -> None:
    family, method, cols = _FIT[name]
    sql = f"WITH {FT} SELECT cell_id, {_r(**cols, prob_zero='q')}, n AS n_samples FROM ft"

    @query(name, sql)
    def run(spark, d):
        return fit.fit(_pool(spark, d), _K, "value", family, method).select("cell_id", *cols, "prob_zero", "n_samples")


for _name in _FIT:
    _fits(_name)


def _logistic_sql(keys: str) -> str:
    """CTEs y, it, ll: log-logistic alpha and beta of the samples of v by Newton's method on (location, log scale)."""
    z = "((u - mu) / exp(ls))"
    t = f"((exp({z}) - 1) / (exp({z}) + 1))"
    d = f"((1 - {t} * {t}) / 2)"
    total = lambda e: f"list_sum(list_transform(ys, lambda u: {e}))"
    return f"""y AS (SELECT {keys}, list(ln(x) ORDER BY x) AS ys, avg(ln(x)) AS mu, ln(stddev_pop(ln(x)) * sqrt(3) / pi()) AS ls, count(*) AS pn
      FROM v WHERE x > 0 GROUP BY {keys} HAVING count(*) >= 30),
    it AS (SELECT *, 0 AS turn FROM y UNION ALL SELECT {keys}, ys, mu - (hss * gm - hms * gs) / (hmm * hss - hms * hms), ls - (hmm * gs - hms * gm) / (hmm * hss - hms * hms),
      pn, turn + 1 FROM (SELECT *, -{total(t)} / exp(ls) AS gm, {total(f'(1 - {z} * {t})')} AS gs, {total(d)} / exp(2 * ls) AS hmm,
      {total(f'({t} + {z} * {d})')} / exp(ls) AS hms, {total(f'({z} * {t} + {z} * {z} * {d})')} AS hss FROM it WHERE turn < 40)),
    ll AS (SELECT {keys}, exp(-ls) AS alpha, exp(mu) AS beta FROM it WHERE turn = 40)"""


def _digamma_sql(x: str, slope: bool = False) -> str:
    """digamma (or its derivative): shifted by ten, then the asymptotic series."""
    z = f"({x} + 10)"
    if slope:
        near = f"(1/{z} + 1/(2*{z}*{z}) + 1/(6*{z}**3) - 1/(30*{z}**5) + 1/(42*{z}**7) - 1/(30*{z}**9))"
        return f"({near} + {' + '.join(f'1/(({x}+{i})*({x}+{i}))' for i in range(10))})"
    near = f"(ln({z}) - 1/(2*{z}) - 1/(12*{z}**2) + 1/(120*{z}**4) - 1/(252*{z}**6) + 1/(240*{z}**8))"
    return f"({near} - {' - '.join(f'1/({x}+{i})' for i in range(10))})"


_GAMMA_MLE = f"""WITH RECURSIVE {ST}, g0 AS (SELECT cell_id, avg(x) AS mean, ln(avg(x)) - avg(ln(x)) AS a FROM v WHERE x > 0 GROUP BY 1),
  it AS (SELECT *, (3 - a + sqrt((a - 3) ** 2 + 24 * a)) / (12 * a) AS k, 0 AS turn FROM g0 UNION ALL
    SELECT cell_id, mean, a, k - (ln(k) - {_digamma_sql('k')} - a) / (1 / k - {_digamma_sql('k', True)}), turn + 1 FROM it WHERE turn < 12)
  SELECT st.cell_id, {_r(alpha='least(1000, k)', beta='mean / least(1000, k)', prob_zero='q')}, n AS n_samples FROM st JOIN it ON it.cell_id = st.cell_id AND turn = 12"""
_LOGISTIC_MLE = f"""WITH RECURSIVE {ST}, {_logistic_sql('cell_id')}
  SELECT st.cell_id, {_r(alpha='alpha', beta='beta', prob_zero='q')}, n AS n_samples FROM st LEFT JOIN ll ON ll.cell_id = st.cell_id"""


def _mle(name: str, family: str, sql: str | None = None) -> None:
    @query(name, sql)
    def run(spark, d):
        return fit.fit(_pool(spark, d), _K, "value", family, "mle").drop("distribution", "fitting_method")


# the likelihoods of Pearson III and GEV are searched by a simplex, which is not SQL
_mle("dst1c_gamma_mle", "gamma", _GAMMA_MLE)
_mle("dst3c_pearson3_mle", "pearson3")
_mle("dst5a_log_logistic_mle", "log_logistic", _LOGISTIC_MLE)
_mle("dst7b_gev_mle", "gev")

_NORM = norm_cdf_sql("((x - loc) / scale)")
_P3A = "(4 / greatest(skew * skew, 1e-4))"  # below, the normal distribution
# beyond forty deviations the probability is 1
_P3Y = f"least({_P3A} + 40 * sqrt({_P3A}) + 100, 2 * (x - loc) / scale / (CASE WHEN abs(skew) < 0.01 THEN 0.01 ELSE skew END) + {_P3A})"
_P3 = f"(CASE WHEN {_P3Y} > 0 THEN {_gamma_p(_P3A, _P3Y)} ELSE 0 END)"
_CDF = {
    "dst4_pearson3_cdf": (
        "dst3a_pearson3_moments",
        f"CASE WHEN abs(skew) < 0.01 THEN {_NORM} ELSE greatest(1e-10, least(1 - 1e-10, 0.5 + sign(skew) * ({_P3} - 0.5))) END",
    ),
    "dst2_gamma_cdf": ("dst1a_gamma_moments", "greatest(1e-10, least(1 - 1e-10, prob_zero + (1 - prob_zero) * " + _gamma_p("alpha", "(x / beta)") + "))"),
    "dst6_log_logistic_cdf": ("dst5b_log_logistic_moments", "prob_zero + (1 - prob_zero) / (1 + (x / beta) ** (-alpha))"),
    "dst8_gev_cdf": ("dst7a_gev_lmoments", "CASE WHEN 1 - shape * (x - loc) / scale > 0 THEN exp(-((1 - shape * (x - loc) / scale) ** (1 / shape))) WHEN shape > 0 THEN 1 ELSE 0 END"),
    "dst10_gen_logistic_cdf": ("dst9a_gen_logistic_lmoments", "CASE WHEN shape > 0 THEN (1 + exp(-(x - loc) / scale)) ** (-shape) END"),
}


def _cdfs(name: str) -> None:
    of, expr = _CDF[name]
    family, method, cols = _FIT[of]
    fitted = ", ".join(f"{sql} AS {n}" for n, sql in cols.items())
    sql = f"""WITH {FT}, f AS (SELECT cell_id, {fitted}, q AS prob_zero FROM ft)
    SELECT cell_id, time, {_r(cdf=f'CASE WHEN x IS NULL THEN NULL ELSE {expr} END')} FROM (SELECT m.cell_id, m.time, m.value AS x, f.* EXCLUDE (cell_id) FROM m JOIN f ON f.cell_id = m.cell_id)"""

    @query(name, sql)
    def run(spark, d):
        df = _pool(spark, d)
        return fit.with_cdf(df, fit.fit(df, _K, "value", family, method), _K, "value", family).select("cell_id", "time", "cdf")


for _name in _CDF:
    _cdfs(_name)


@query(
    "dst12_normal_quantile",
    f"WITH p AS (SELECT l_orderkey, l_linenumber, (l_linenumber * 100000 + l_orderkey % 99991 + 1) / 800000.0 AS p FROM lineitem) "
    f"SELECT l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber, {_r(z=norm_ppf_sql('CAST(p AS DOUBLE)'))} FROM p",
)
def dst12(spark, d):
    p = (F.col("l_linenumber") * 100000 + F.col("l_orderkey") % 99991 + 1) / 800000.0
    return views.table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), norm_ppf(p).alias("z"))


_LMOMENT_FITS = {
    "gamma": ("dst1b_gamma_lmoments", "dst2_gamma_cdf"),
    "pearson3": ("dst3b_pearson3_lmoments", "dst4_pearson3_cdf"),
    "log_logistic": ("dst5c_log_logistic_lmoments", "dst6_log_logistic_cdf"),
    "gev": ("dst7a_gev_lmoments", "dst8_gev_cdf"),
    "gen_logistic": ("dst9a_gen_logistic_lmoments", "dst10_gen_logistic_cdf"),
}


def _probabilities(fits: dict[str, tuple[str, str]]) -> str:
    """CTE c (cell_id, distribution, np, valid, prob_zero, x, c) of each value under each family."""
    parts = []
    for n, (family, (of, cdf)) in enumerate(fits.items()):
        cols = _FIT[of][2]
        fitted = ", ".join(f"{sql} AS {name}" for name, sql in cols.items())
        valid = " AND ".join(f"{name} IS NOT NULL" for name in cols)
        parts.append(
            f"SELECT cell_id, {n} AS place, '{family}' AS distribution, {len(cols)} AS np, {valid} AS valid, prob_zero, x, {_CDF[cdf][1]} AS c "
            f"FROM (SELECT v.cell_id, v.x, f.* EXCLUDE (cell_id) FROM v JOIN (SELECT cell_id, {fitted}, q AS prob_zero FROM ft) f ON f.cell_id = v.cell_id)"
        )
    return "c AS (" + " UNION ALL ".join(parts) + ")"


def _goodness_sql(fits: dict[str, tuple[str, str]]) -> str:
    """CTE g: one row for each sample and family."""
    z = f"CASE WHEN h IS NOT NULL THEN greatest(-3.09, least(3.09, {norm_ppf_sql('h')})) END"
    return f"""WITH {FT}, {_probabilities(fits)},
    r AS (SELECT *, row_number() OVER (PARTITION BY cell_id, distribution ORDER BY x) AS i, count(c) OVER w AS m,
      (c - avg(c) OVER w) / nullif(stddev_samp(c) OVER w, 0) AS u, CASE WHEN c IS NOT NULL THEN greatest(1e-10, least(1 - 1e-10, c)) END AS h
      FROM c WINDOW w AS (PARTITION BY cell_id, distribution)),
    y AS (SELECT *, CASE WHEN u IS NOT NULL THEN {norm_cdf_sql('u')} END AS p, {z} AS z FROM r),
    g AS (SELECT cell_id, distribution, any_value(place) AS place, any_value(valid) AS valid, any_value(prob_zero) AS prob_zero, count(*) AS n_samples,
      max(greatest(i / CAST(m AS DOUBLE) - c, c - (i - 1) / CAST(m AS DOUBLE))) AS ks_statistic,
      CASE WHEN max(m) > 0 THEN -max(m) - sum((2 * i - 1) * ln(p) + (2 * (m - i) + 1) * ln(1 - p)) / max(m) END AS ad_statistic,
      2 * max(np) - 2 * sum(-z * z / 2 - 0.5 * ln(2 * pi())) AS aic,
      max(np) * ln(count(*)) - 2 * sum(-z * z / 2 - 0.5 * ln(2 * pi())) AS bic FROM y GROUP BY cell_id, distribution)"""


_MEASURES = {c: f"CASE WHEN n_samples >= 30 THEN {c} END" for c in ("ks_statistic", "ad_statistic", "aic", "bic")}


@query("dst13_goodness_of_fit", f"{_goodness_sql({'gamma': ('dst1a_gamma_moments', 'dst2_gamma_cdf')})} SELECT cell_id, {_r(**_MEASURES)} FROM g")
def dst13(spark, d):
    df = _pool(spark, d)
    return fit.goodness_of_fit(df, fit.fit(df, _K, "value", "gamma"), _K, "value", "gamma").drop("ks_pvalue")


@query("dst13_ks_pvalue")
def dst13_p(spark, d):
    """The exact distribution of the statistic isn't SQL; tests hold it against enumeration."""
    return fit.compare(_pool(spark, d), _K, "value").select("cell_id", "distribution", "ks_statistic", "ks_pvalue")


@query(
    "dst14_compare_distributions",
    f"{_goodness_sql(_LMOMENT_FITS)} SELECT cell_id, distribution, valid, n_samples, {_r(prob_zero='prob_zero', **_MEASURES)} FROM g",
)
def dst14(spark, d):
    return fit.compare(_pool(spark, d), _K, "value").drop("params", "ks_pvalue")


@query(
    "dst15_select_best",
    f"{_goodness_sql(_LMOMENT_FITS)} SELECT cell_id, coalesce(arg_min(distribution, struct_pack(a := aic, p := place)) FILTER (valid AND n_samples >= 30), 'gamma') AS distribution FROM g GROUP BY cell_id",
)
def dst15(spark, d):
    return fit.select_best(_pool(spark, d), _K, "value")


_ONE_ZERO = "CASE WHEN n > 0 THEN CAST(z AS DOUBLE) / n ELSE 1 END"
_NOTES = (
    "n_total > n", "'not_finite=' || (n_total - n)", "n < 30", "'values=' || n || '<30'",
    "z > 0.95 * n", "'zero_share>0.95'", "z > 0.8 * n AND z <= 0.95 * n", "'zero_share>0.8'", "np < 10", "'positive=' || np || '<10'",
    "var < 1e-8", "'variance<1e-08'", "neg > 0", "'negative=' || neg",
)


@query(
    "dst16_diagnose",
    f"""WITH {ST}, t AS (SELECT cell_id, count(*) AS n_total FROM m GROUP BY 1), pz AS (SELECT cell_id, count(*) FILTER (x > 1e-10) AS np,
      count(*) FILTER (abs(x) < 1e-10) AS z, count(*) FILTER (x < -1e-10) AS neg FROM v GROUP BY 1)
    SELECT t.cell_id, n_total, n AS n_valid, z AS n_zeros, np AS n_positive, neg AS n_negative,
      {_r(zero_proportion=_ONE_ZERO, mean='l1', std='sd', variance='var', skewness='m3 / sd ** 3', min_value='lo', max_value='hi')},
      n >= 30 AND z <= 0.95 * n AND np >= 10 AND neg = 0 AS is_suitable_for_gamma, n >= 30 AND z <= 0.95 * n AS is_suitable_for_pearson3,
      list_aggregate([x for x in [{', '.join(f'CASE WHEN {c} THEN {t} END' for c, t in zip(_NOTES[::2], _NOTES[1::2], strict=True))}] if x IS NOT NULL], 'string_agg', '; ') AS notes,
      CASE WHEN z > 0.95 * n THEN 'longer_scale' WHEN n < 30 THEN 'more_values' WHEN np >= 10 AND neg = 0 AND z > 0.5 * n THEN 'any_by_lmoments'
        WHEN np >= 10 AND neg = 0 THEN 'any' ELSE 'pearson3' END AS recommendation
    FROM t JOIN st ON st.cell_id = t.cell_id JOIN pz ON pz.cell_id = t.cell_id""",
)
def dst16(spark, d):
    out = fit.diagnose(_pool(spark, d), _K, "value")
    return out.withColumn("notes", F.nullif(F.array_join("warnings", "; "), F.lit(""))).drop("warnings")


def _years(spark, d) -> DataFrame:
    """The months of each supplier and year: samples too short for most fits."""
    return _pool(spark, d).withColumn("year", F.year("time"))


@query(
    "dst17_diagnose_failure",
    f"""WITH {M}, a AS (SELECT cell_id, CAST(year(time) AS INT) AS year, count(value) AS n, count(*) FILTER (value > 1e-10) AS np, count(*) FILTER (abs(value) < 1e-10) AS z,
      CASE WHEN count(value) = 1 THEN 0 ELSE var_samp(value) END AS var FROM m GROUP BY ALL UNION ALL
      SELECT cell_id, NULL, count(value), count(*) FILTER (value > 1e-10), count(*) FILTER (abs(value) < 1e-10), var_samp(value) FROM m GROUP BY 1),
    b AS (SELECT *, [x for x in [CASE WHEN n < 30 THEN 'values=' || n || '<30' END, CASE WHEN {_ONE_ZERO} > 0.95 THEN 'zero_share>0.95' END,
      CASE WHEN np < 10 THEN 'positive=' || np || '<10' END, CASE WHEN var < 1e-8 THEN 'variance<1e-08' END] if x IS NOT NULL] AS why FROM a)
    SELECT cell_id, year, CASE WHEN n >= 30 THEN 'fitted' ELSE 'gev not fitted: ' || list_aggregate(why, 'string_agg', ', ') END AS reason FROM b""",
)
def dst17(spark, d):
    def reasons(df, keys):
        return fit.diagnose_failure(fit.diagnose(df, keys, "value"), fit.fit(df, keys, "value", "gev"), keys, "gev")

    whole = reasons(_pool(spark, d), _K).withColumn("year", F.lit(None).cast("int"))
    return reasons(_years(spark, d), ["cell_id", "year"]).unionByName(whole)


_POOLED = f"greatest(1e-10, least(1 - 1e-10, CASE WHEN x IS NOT NULL THEN {_CDF['dst4_pearson3_cdf'][1]} END))"


@query(
    "idx8_spei_pearson3_pooled",
    f"""WITH {FT}, f AS (SELECT cell_id, {', '.join(f'{sql} AS {n}' for n, sql in _FIT['dst3a_pearson3_moments'][2].items())} FROM ft),
    h AS (SELECT cell_id, time, {_POOLED} AS h, x FROM (SELECT m.cell_id, m.time, m.value AS x, f.* EXCLUDE (cell_id) FROM m JOIN f ON f.cell_id = m.cell_id))
    SELECT cell_id, time, CASE WHEN x IS NOT NULL THEN CAST(round({_clip('h')}, 4) + 0.0 AS DOUBLE) END AS z FROM h""",
    4,
)
def idx8(spark, d):
    df = _pool(spark, d)
    p = fit.fit(df, _K, "value", "pearson3")
    return standardize(fit.with_cdf(df, p, _K, "value", "pearson3"), {"z": F.col("cdf")}).select("cell_id", "time", "z")


def _generic_sql(index_name: str, value: str, family: str, of: str | None, cdf: str, scales: tuple[int, ...]) -> str:
    """An index of a family other than gamma: fits (``of``; none: by likelihood) by cell and calendar month, scale by scale."""
    base = f"{LM}, t AS (SELECT cell_id, time, month(time) AS period, {', '.join(f'v{s}' for s in scales)} FROM ({_rolled('(SELECT *, ' + value + ' AS amount FROM m)', 'amount', *scales)}))"
    out, join = [], ""
    for s in scales:
        fitted = ", ".join(f"{sql} AS {n}" for n, sql in _FIT[of][2].items()) if of else ""
        inner = f"v AS (SELECT cell_id, period, v{s} AS x FROM t WHERE v{s} IS NOT NULL AND year(time) BETWEEN 1961 AND 1995), {_sample_sql('cell_id, period')}{_FT}"
        f = f"f AS (SELECT cell_id, period, n, {fitted} FROM ft WHERE n >= 30)"
        if not of:
            f = f"{_logistic_sql('cell_id, period')}, f AS (SELECT st.cell_id, st.period, n, alpha, beta, q AS prob_zero FROM st JOIN ll ON ll.cell_id = st.cell_id AND ll.period = st.period)"
        base += f""", h{s} AS (WITH RECURSIVE {inner}, {f}
        SELECT cell_id, time, CASE WHEN c IS NOT NULL THEN greatest(1e-10, least(1 - 1e-10, c)) END AS h FROM (
          SELECT t.cell_id, t.time, CASE WHEN x IS NOT NULL AND n IS NOT NULL THEN {_CDF[cdf][1]} END AS c
          FROM (SELECT t.cell_id, t.time, t.period, t.v{s} AS x FROM t) t LEFT JOIN f ON f.cell_id = t.cell_id AND f.period = t.period))"""
        out.append(f"CASE WHEN h{s}.h IS NOT NULL THEN CAST(round({_clip(f'h{s}.h')}, 4) + 0.0 AS DOUBLE) END AS {index_name}_{family}_{s}_month")
        join += f" JOIN h{s} ON h{s}.cell_id = t.cell_id AND h{s}.time = t.time"
    return f"WITH {base} SELECT t.cell_id, t.time, {', '.join(out)} FROM t{join}"


def _generic(name: str, index_name: str, family: str, of: str | None, cdf: str, scales: tuple[int, ...]) -> None:
    value = "value" if index_name == "spi" else "value - pet + 1000"
    sql = _generic_sql(index_name, value, family, of, cdf, scales)

    @query(name, sql, 4)
    def run(spark, d):
        df, how = views.long_monthly(spark, d), {"distribution": family, **LONG_CAL}
        out = index.spi(df, list(scales), **how) if index_name == "spi" else index.spei(df, list(scales), "value", "pet", **how)
        # the names of families hold no underscore in columns' names
        return out.select("cell_id", "time", *(F.col(index.variable_name(index_name, s, Periodicity.monthly, family)).alias(f"{index_name}_{family}_{s}_month") for s in scales))


_generic("idx8_spi_pearson3", "spi", "pearson3", "dst3a_pearson3_moments", "dst4_pearson3_cdf", (3, 6))
_generic("idx8_spi_gev", "spi", "gev", "dst7a_gev_lmoments", "dst8_gev_cdf", (3, 6))
_generic("idx8_spi_gen_logistic", "spi", "gen_logistic", "dst9a_gen_logistic_lmoments", "dst10_gen_logistic_cdf", (3,))
_generic("idx8_spei_pearson3", "spei", "pearson3", "dst3a_pearson3_moments", "dst4_pearson3_cdf", (6,))
_generic("idx8_spei_gev", "spei", "gev", "dst7a_gev_lmoments", "dst8_gev_cdf", (3, 6))
_generic("idx8_spi_log_logistic", "spi", "log_logistic", None, "dst6_log_logistic_cdf", (3, 6))


@query(
    "agg3_zero_share",
    f"WITH {LM} SELECT cell_id, CAST(month(time) AS INT) AS period, {_r(alpha='2.0', beta='30.0', prob_zero='CAST(count(*) FILTER (value = 0) AS DOUBLE) / count(value)')} "
    "FROM m WHERE year(time) BETWEEN 1961 AND 1995 GROUP BY 1, 2",
)
def agg3(spark, d):
    df = views.long_monthly(spark, d)
    given = df.select("cell_id", F.month("time").alias("period")).distinct().withColumns({"alpha": F.lit(2.0), "beta": F.lit(30.0)})
    return index.with_zero_share(given, df, "value", **LONG_CAL)


# ---------------------------------------------------------------- evapotranspiration and calendars

_DAYS = """d AS (SELECT lat, y % 4 = 0 AS leap, CAST(day AS DATE) AS day, radians(lat) AS f, CAST(dayofyear(day) AS DOUBLE) AS doy
  FROM (SELECT DISTINCT lat FROM m) l CROSS JOIN (SELECT y, unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), INTERVAL 1 DAY)) AS day
  FROM (VALUES (2000), (2001)) AS t(y)) x),
w AS (SELECT *, 0.409 * sin(2 * pi() / 365 * doy - 1.39) AS dec FROM d),
a AS (SELECT *, acos(greatest(-1, least(1, -tan(f) * tan(dec)))) AS ang FROM w),
b AS (SELECT lat, leap, CAST(month(day) AS INT) AS month, avg(24 / pi() * ang) AS light,
  avg(greatest(0, 24 * 60 / pi() * 0.0820 * (1 + 0.033 * cos(2 * pi() / 365 * doy)) * (ang * sin(f) * sin(dec) + cos(f) * cos(dec) * sin(ang)))) AS ra
  FROM a GROUP BY 1, 2, 3)"""
_ON = "b.lat = m.lat AND b.month = month(m.time) AND b.leap = (year(m.time) % 4 = 0)"


@query("scl4_daylight", f"WITH {M}, {_DAYS} SELECT lat, leap, month, {_r(mean='light')} FROM b")
def scl4(spark, d):
    return pet.monthly_daylight(views.monthly(spark, d))


@query("scl6_radiation", f"WITH {M}, {_DAYS} SELECT lat, leap, month, {_r(mean='ra')} FROM b")
def scl6(spark, d):
    return pet.monthly_radiation(views.monthly(spark, d))


_HEAT = """h AS (SELECT cell_id, sum((t / 5) ** 1.514) AS i FROM (SELECT cell_id, month(time), avg(greatest(tmean, 0)) AS t
      FROM m WHERE tmean IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""
_THORNTHWAITE = """CASE WHEN tmean IS NOT NULL THEN 16 * (light / 12) * (day(last_day(time)) / 30.0) * (10 * greatest(tmean, 0) / i)
  ** (6.75e-7 * i ** 3 - 7.71e-5 * i ** 2 + 1.792e-2 * i + 0.49239) END"""


@query(
    "pet1_thornthwaite",
    f"""WITH {M}, {_DAYS}, {_HEAT}
    SELECT m.cell_id, time, {_r(pet=_THORNTHWAITE)}
    FROM m LEFT JOIN h ON h.cell_id = m.cell_id JOIN b ON {_ON}""",
)
def pet1(spark, d):
    return pet.thornthwaite(views.monthly(spark, d)).select("cell_id", "time", "pet")


@query(
    "pet2_hargreaves",
    f"""WITH {M}, {_DAYS} SELECT m.cell_id, time, {_r(pet='CASE WHEN tmean IS NOT NULL THEN greatest(0, 0.0023 * ra * 0.408 * (tmean + 17.8) * sqrt(greatest(tmax - tmin, 0)) * day(last_day(time))) END')}
    FROM m JOIN b ON {_ON}""",
)
def pet2(spark, d):
    return pet.hargreaves(views.monthly(spark, d)).select("cell_id", "time", "pet")


ORACLES["idx4_spei_multi_scale"] = _spi_sql(
    f"""{M.replace("m AS (", "m0 AS (")}, {_DAYS.replace("FROM m)", "FROM m0)")}, {_HEAT.replace("FROM m WHERE", "FROM m0 WHERE")},
    m AS (SELECT m.cell_id, m.time, m.value - {_THORNTHWAITE} + 1000 AS value FROM m0 m LEFT JOIN h ON h.cell_id = m.cell_id JOIN b ON {_ON})""",
    (1, 3, 6),
    name="spei",
)


def _daily(spark, d) -> DataFrame:
    """Orders of each day and class of customers: every day of the whole years that the orders span."""
    o = views.table(spark, d, "orders").where("o_orderdate is not null")
    counts = o.groupBy((F.col("o_custkey") % 5).alias("cell_id"), F.col("o_orderdate").cast("date").alias("time")).agg(
        F.count("*").cast("double").alias("value")
    )
    year, one, end = F.year("o_orderdate"), F.lit(1), (F.lit(12), F.lit(31))
    span = o.agg(F.make_date(F.min(year), one, one).alias("first"), F.make_date(F.max(year), *end).alias("last"))
    full = counts.select("cell_id").distinct().crossJoin(F.broadcast(span)).select("cell_id", F.explode(F.sequence("first", "last")).alias("time"))
    return full.join(counts, ["cell_id", "time"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


D = """o AS (SELECT o_custkey % 5 AS cell_id, CAST(o_orderdate AS DATE) AS time, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1, 2),
span AS (SELECT make_date(min(year(o_orderdate)), 1, 1) AS a, make_date(max(year(o_orderdate)), 12, 31) AS b FROM orders),
days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS time FROM span),
dd AS (SELECT c.cell_id, days.time, coalesce(o.value, 0) AS value FROM (SELECT DISTINCT cell_id FROM o) c CROSS JOIN days
  LEFT JOIN o ON o.cell_id = c.cell_id AND o.time = days.time)"""
_TO366 = """SELECT cell_id, year(time) AS year, dayofyear(time) + CASE WHEN year(time) % 4 <> 0 AND dayofyear(time) >= 60 THEN 1 ELSE 0 END AS day_366, value FROM dd
  UNION ALL SELECT a.cell_id, year(a.time), 60, (a.value + b.value) / 2 FROM dd a JOIN dd b ON a.cell_id = b.cell_id AND b.time = a.time + 1
  WHERE month(a.time) = 2 AND day(a.time) = 28 AND year(a.time) % 4 <> 0"""


@query("cal1_366", f"WITH {D} SELECT cell_id, CAST(year AS INT) AS year, CAST(day_366 AS INT) AS day_366, {_r(value='value')} FROM ({_TO366})")
def cal1(spark, d):
    return calendar.to_366(_daily(spark, d))


@query("cal2_gregorian", f"WITH {D} SELECT cell_id, time, {_r(value='value')} FROM dd")
def cal2(spark, d):
    return calendar.to_gregorian(cal1(spark, d))


_DAY = "dayofyear(time) + CASE WHEN year(time) % 4 <> 0 AND dayofyear(time) >= 60 THEN 1 ELSE 0 END"


@query(
    "idx13_spi_daily",
    _spi_sql(f"{D}, m AS (SELECT * FROM dd)", (30,)).replace("month(time)", _DAY).replace("month(t.time)", _DAY.replace("time", "t.time")).replace("_30_month", "_30_day"),
    4,
)
def idx13(spark, d):
    return index.spi(_daily(spark, d), 30, periodicity=Periodicity.daily, **CAL).select("cell_id", "time", "spi_gamma_30_day")


@query("cal4_days_since", f"WITH {M} SELECT DISTINCT time, CAST(date_diff('day', DATE '1800-01-01', time) AS INT) AS days_since_1800 FROM m")
def cal4(spark, d):
    return calendar.time_axis(spark, views.START, 84).drop("step")


@query(
    "mem4_tiles",
    """SELECT CAST(i * 9 + j AS INT) AS tile, CAST(i * 500 AS INT) AS lat_start, CAST(least((i + 1) * 500, 2160) AS INT) AS lat_end,
    CAST(j * 500 AS INT) AS lon_start, CAST(least((j + 1) * 500, 4320) AS INT) AS lon_end FROM range(5) a(i) CROSS JOIN range(9) b(j)""",
)
def mem4(spark, d):
    return planning.tile_table(spark, 2160, 4320)


# ---------------------------------------------------------------- adapters, naming, plot data

_CLASSES = "(VALUES " + ", ".join(f"({i}, {top if top < 99 else 99.0}, '{name}', '{shade}')" for i, (top, name, shade) in enumerate(classify.ELEVEN)) + ") AS k(i, top, name, shade)"


@query("flt7_has_valid", f"WITH {M} SELECT cell_id, count(value) > 0 AS is_valid FROM m GROUP BY 1")
def flt7(spark, d):
    return grid.has_valid(views.monthly(spark, d))


@query("flt6_below_threshold", f"WITH {Z} SELECT cell_id, time, {_r(value='value')} FROM z WHERE value < -1 AND year(time) BETWEEN 1996 AND 1999")
def flt6(spark, d):
    return views.scores(spark, d).where((F.col("value") < -1) & index.in_calibration("time", 1996, 1999))


@query("prj1_not_negative", f"WITH {Z} SELECT cell_id, time, {_r(amount='CASE WHEN value < 0 THEN 0 ELSE value END')} FROM z")
def prj1(spark, d):
    return views.scores(spark, d).select("cell_id", "time", index.not_negative(F.col("value")).alias("amount"))


@query(
    "src3_missing_values",
    "SELECT l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber, CASE WHEN l_linenumber % 3 = 0 OR l_linenumber % 3 = 1 AND l_discount = 0.05 THEN NULL "
    "ELSE CAST(round(l_quantity, 6) AS DOUBLE) END AS value FROM lineitem",
)
def src3(spark, d):
    v = F.when(F.col("l_linenumber") % 3 == 0, float("nan")).when((F.col("l_linenumber") % 3 == 1) & (F.col("l_discount") == 0.05), -9999.0)
    rows = views.table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), v.otherwise(F.col("l_quantity")).alias("value"))
    return grid.missing_to_null(rows, "value")


@query("cal5_densify_daily", f"WITH {D} SELECT cell_id, time, {_r(value='value')} FROM dd")
def cal5(spark, d):
    o = views.table(spark, d, "orders").where("o_orderdate is not null")
    counts = o.groupBy((F.col("o_custkey") % 5).alias("cell_id"), F.col("o_orderdate").cast("date").alias("time")).agg(F.count("*").cast("double").alias("value"))
    first, last = o.agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    return grid.densify(counts, f"{first}-01-01", f"{last}-12-31", "value", 0.0, periodicity=Periodicity.daily)


@query(
    "srt3_driest_cells",
    f"WITH {Z}, i AS ({_islands('z', 'value < -0.5')}), {_BY_CELL.format(k='cell_id')}, g AS (SELECT cell_id, {_COUNTED}, max(mg) FILTER (ok) AS mg FROM e GROUP BY 1) "
    f"SELECT cell_id, num_events, {_r(max_magnitude='mg')} FROM g ORDER BY num_events DESC, cell_id LIMIT 10",
)
def srt3(spark, d):
    """A report of the ten cells with most events."""
    cells = runs.spatial_events(views.scores(spark, d), -0.5, 2)
    return cells.select("cell_id", "num_events", "max_magnitude").orderBy(F.desc("num_events"), "cell_id").limit(10)


@query(
    "vis1_index_bars",
    f"WITH {Z}, c AS (SELECT z.*, (SELECT min(i) FROM {_CLASSES} WHERE z.value <= top) AS n FROM z WHERE value IS NOT NULL) "
    f"SELECT cell_id, time, {_r(value='value')}, k.name AS class, k.shade AS colour FROM c JOIN {_CLASSES} ON k.i = c.n",
)
def vis1(spark, d):
    return frames.index_bars(views.scores(spark, d))


@query(
    "vis2_event_spans",
    f"WITH {Z}, i AS ({_islands('z', 'value < -0.5')}), r AS ({_run_rows(-0.5)}), v AS (SELECT {_EVENT_COLS}, row_number() OVER w AS event_id "
    "FROM r WHERE duration >= 2 WINDOW w AS (PARTITION BY cell_id ORDER BY start_idx)) "
    "SELECT cell_id, CAST(event_id AS INT) AS event_id, start_date, end_date, peak_date, peak FROM v",
)
def vis2(spark, d):
    return frames.event_spans(views.scores(spark, d), -0.5, 2)


@query(
    "vis3_event_metric",
    f"WITH {Z}, i AS ({_islands('z', 'value < -0.5')}), r AS ({_run_rows(-0.5)}) SELECT cell_id, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY start_idx) AS INT) AS event_id, "
    f"start_date, {_r(value='CAST(duration AS DOUBLE)', mean='avg(duration) OVER (PARTITION BY cell_id)')} FROM r",
)
def vis3(spark, d):
    return frames.event_metric(runs.identify_events(views.scores(spark, d), -0.5), "duration")


@query(
    "vis5_map",
    f"WITH {M}, c AS (SELECT cell_id, any_value(lat) AS lat, avg(value) AS v FROM m GROUP BY 1) SELECT {_r(lat='lat', lon='cell_id % 360', value='v')} FROM c",
)
def vis5(spark, d):
    df = views.monthly(spark, d)
    cells = df.groupBy("cell_id").agg(F.any_value("lat").alias("lat")).withColumn("lon", (F.col("cell_id") % 360).cast("double"))
    return frames.map_of(df.groupBy("cell_id").agg(F.avg("value").alias("mean")), cells, "mean")


@query(
    "pet3_hargreaves_by_name",
    ORACLES["pet2_hargreaves"],
)
def pet3(spark, d):
    return pet.potential_evapotranspiration(views.monthly(spark, d), "tmean", "lat", "hargreaves", "tmin", "tmax").select("cell_id", "time", "pet")


@query(
    "mem1_estimates",
    f"""WITH s AS (SELECT *, CAST(8 AS DOUBLE) * n_time * n_lat * n_lon / 1073741824 AS gb, CAST(floor(sqrt(floor(16 * 0.7 / 12 * 1073741824 / (n_time * 8)))) AS INT) AS side
      FROM (VALUES (408, 165, 244), (528, 2160, 4320), (539, 2400, 7200)) AS t(n_time, n_lat, n_lon)),
    c AS (SELECT *, gb * 12 <= 16 * 0.7 AS fits, greatest(least(side, n_lat), 100) AS a, greatest(least(side, n_lon), 100) AS b FROM s)
    SELECT n_time, n_lat, n_lon, {_r(input_gb='gb', peak_gb='gb * 12')}, CASE WHEN fits THEN n_lat ELSE a END AS chunk_lat, CASE WHEN fits THEN n_lon ELSE b END AS chunk_lon,
      CAST(CASE WHEN fits THEN 1 ELSE ceil(n_lat / CAST(a AS DOUBLE)) * ceil(n_lon / CAST(b AS DOUBLE)) END AS INT) AS n_chunks, fits FROM c""",
)
def mem1(spark, d):
    return planning.estimates(spark, [(408, 165, 244), (528, 2160, 4320), (539, 2400, 7200)], 16.0)
