import random

import pytest
from pyspark.sql import functions as F

from climext import annual_statistics, compare_periods, from_series, identify_events, monitor, period_statistics, runs, spatial_events, summarize_events
from climext.operators.classify import area_percentage, eleven_class, mckee_class
from climext.operators.runs import event_state


def loop_runs(v, t, below):
    out, run = [], []
    for i, x in enumerate([*v, None]):
        if x is not None and (x < t if below else x > t):
            run.append(i)
        elif run:
            vals = [v[j] for j in run]
            peak = min(vals) if below else max(vals)
            out.append((run[0], run[-1], len(run), sum(abs(a - t) for a in vals), peak, run[vals.index(peak)]))
            run = []
    return out


def loop_monitor(v, t):
    """event id, duration, cumulative magnitude, peak at each step, by one pass."""
    out, event, n, mag, peak = [], 0, 0, 0.0, 0.0
    for x in v:
        if x is None:
            event, n, mag, peak = 0, 0, 0.0, 0.0
            out.append((0, 0, 0.0, 0.0))
        elif x < t:
            event = event or 1
            n, mag, peak = n + 1, mag + abs(x - t), min(peak, x)
            out.append((event, n, mag, peak))
        else:
            event += event > 0
            n, mag, peak = 0, 0.0, 0.0
            out.append((0, 0, 0.0, 0.0))
    return out


def series(seed):
    rng = random.Random(seed)
    return [None if rng.random() < 0.08 else round(rng.gauss(0, 1), 2) for _ in range(240)]


@pytest.mark.parametrize("t,below", [(-1.0, True), (0.7, False), (0.0, False)])
def test_runs_match_loop(spark, t, below):
    v = series(5)
    got = runs(from_series(spark, v), t, below).orderBy("start_idx").collect()
    want = loop_runs(v, t, below)
    assert len(got) == len(want)
    for r, (a, z, n, m, p, at) in zip(got, want, strict=True):
        assert (r.start_idx, r.end_idx, r.duration, r.peak, r.peak_idx) == (a, z, n, p, at)
        assert r.magnitude == pytest.approx(m)


def test_monitor_matches_loop(spark):
    v = series(9)
    got = monitor(from_series(spark, v), -0.5).orderBy("time").collect()
    for r, (e, n, m, p) in zip(got, loop_monitor(v, -0.5), strict=True):
        assert (r.event_id, r.duration, r.peak_so_far) == (e, n, p)
        assert r.magnitude_cumulative == pytest.approx(m)


def test_monitor_event_ids(spark):
    got = monitor(from_series(spark, [-2.0, 0.0, 0.0, -2.0, None, -2.0]), -1.0).orderBy("time").collect()
    assert [r.event_id for r in got] == [1, 0, 0, 3, 0, 1] and [r.duration for r in got] == [1, 0, 0, 1, 0, 1]


def test_events_small(spark):
    v = [0.5, -1.2, -1.5, -0.8, 0.3, -1.1, -1.3]
    got = identify_events(from_series(spark, v)).orderBy("event_id").collect()
    assert [(r.start_idx, r.end_idx, r.duration, r.peak, r.peak_idx, r.interarrival) for r in got] == [
        (1, 2, 2, -1.5, 2, 4), (5, 6, 2, -1.3, 6, None)]
    assert [r.magnitude for r in got] == pytest.approx([0.7, 0.4]) and [r.intensity for r in got] == pytest.approx([0.35, 0.2])
    assert identify_events(from_series(spark, [-2.0, -1.5, -2.0])).first().peak_idx == 0
    empty = identify_events(from_series(spark, [1.0, 2.0]))
    assert empty.count() == 0 and "interarrival" in empty.columns
    assert summarize_events(empty).first().num_events == 0


def test_period_statistics_without_events_and_across_years(spark):
    df = from_series(spark, [0.0] * 11 + [-2.0, -2.0] + [0.0] * 11, "2000-01-01").unionByName(from_series(spark, [1.0] * 24, "2000-01-01", cell_id=1))
    r = {x.cell_id: x for x in period_statistics(df, -1.0).collect()}
    assert (r[1].num_events, r[1].total_event_months, r[1].total_magnitude, r[1].pct_time_in_event, r[1].mean_magnitude) == (0, 0, 0.0, 0.0, None)
    assert r[0].num_events == 1
    by_year = {(x.cell_id, x.year): x.num_events for x in annual_statistics(df, -1.0).collect()}
    assert by_year == {(0, 2000): 1, (0, 2001): 1, (1, 2000): 0, (1, 2001): 0}
    assert all(x.num_events == 0 for x in annual_statistics(df, -1.0, min_duration=2).collect())
    cmp = {(x.cell_id, x.period): x.num_events for x in compare_periods(df, [(2000, 2000), (2000, 2001)], -1.0).collect()}
    assert cmp[0, "2000-2000"] == 1 and cmp[0, "2000-2001"] == 1
    with pytest.raises(ValueError):
        compare_periods(df, [(2000, 2000)], names=["a", "b"])
    s = {x.cell_id: x for x in spatial_events(df, -1.0).collect()}
    assert s[1].num_events == 0 and s[1].max_duration is None


def test_states_and_classes(spark):
    vs = [-1.5, None, -1.0, 1.5, 2.0, 1.0, 0.99, -0.99, -2.0, -0.5, 0.5, 2.01]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "i int, v double")
    got = df.select("i", event_state(F.col("v"), -1.0).alias("d"), mckee_class(F.col("v")).alias("m"), eleven_class(F.col("v")).alias("e")).orderBy("i").collect()
    assert tuple(got[0].d) == (True, "Moderate Drought", 0.5) and tuple(got[1].d) == (False, "No Data", 0.0)
    assert tuple(got[2].d) == (False, "No Event", 0.0)
    assert [r.m for r in got] == [-1, None, 0, 3, 4, 2, 1, 1, -2, 1, 1, 4]
    assert [got[i].e for i in (8, 9, 10, 4, 11)] == ["exceptionally_dry", "abnormally_dry", "near_normal", "extremely_moist", "exceptionally_moist"]
    wet = df.where("i = 3").select(event_state(F.col("v"), 1.0).alias("d")).first()
    assert tuple(wet.d) == (True, "Moderately Wet", 0.5)
    area = df.where("i in (1, 2)").unionByName(spark.createDataFrame([(9, -0.9)], "i int, v double"))
    assert area_percentage(area.withColumn("time", F.lit(1)), -1.0, "v").first().area_percentage == 50.0
