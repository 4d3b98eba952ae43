import datetime as dt
import math
import re
from collections import Counter
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest

from climext.operators import fit
from climext.queries import QUERIES

MONTHS = [dt.datetime(1995 + i // 12, 1 + i % 12, 9) for i in range(84)]


def _ship(path, cells: dict[int, list[float | None]]) -> str:
    """One line a month for each supplier's quantities; no line where there is none."""
    lines = [(cell, at, float(q), 0.05, "N") for cell, values in cells.items() for at, q in zip(MONTHS, values) if q is not None]
    names = ["l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_returnflag"]
    pd.DataFrame(lines, columns=names).astype({"l_shipdate": "datetime64[us]"}).to_parquet(path / "lineitem.parquet")
    pd.DataFrame({"s_suppkey": list(cells)}).to_parquet(path / "supplier.parquet")
    return str(path)


def test_calendar_queries_take_every_order(spark, tmp_path):
    stamps = [dt.datetime(1995, 3, 5, 7), dt.datetime(1997, 12, 31), dt.datetime(1999, 2, 28), dt.datetime(1999, 3, 1), dt.datetime(2001, 8, 1, 23)]
    orders = [(key, at) for i, at in enumerate(stamps) for key in (1, 2, 6)[: 1 + i % 3]]
    pd.DataFrame(orders, columns=["o_custkey", "o_orderdate"]).astype({"o_orderdate": "datetime64[us]"}).to_parquet(tmp_path / "orders.parquet")
    count = Counter((key % 5, at.date()) for key, at in orders)
    days = [dt.date(1995, 1, 1) + dt.timedelta(i) for i in range(2557)]
    assert days[-1] == dt.date(2001, 12, 31)
    whole = {(cell, day): float(count[cell, day]) for cell in {key % 5 for key, _ in orders} for day in days}
    back = QUERIES["cal2_gregorian"](spark, str(tmp_path)).collect()
    assert len(back) == len(whole) and {(r["cell_id"], r["time"]): r["value"] for r in back} == whole
    wide = QUERIES["cal1_366"](spark, str(tmp_path)).collect()
    assert len(wide) == 2 * 7 * 366
    made = {(r["cell_id"], r["year"]): r["value"] for r in wide if r["day_366"] == 60}
    assert made == {(c, y): whole[c, dt.date(y, 2, 29)] if y % 4 == 0 else (whole[c, dt.date(y, 2, 28)] + whole[c, dt.date(y, 3, 1)]) / 2 for c in (1, 2) for y in range(1995, 2002)}


def test_failures_are_diagnosed_on_whole_samples(spark, tmp_path):
    rng = np.random.default_rng(5)
    some = [*rng.gamma(3.0, 20.0, 20), *[None] * 64]
    d = _ship(tmp_path, {1: list(rng.gamma(3.0, 20.0, 84)), 2: [7.0] * 84, 3: some, 4: [0.0] * 84, 5: [None] * 84})
    rows = QUERIES["dst17_diagnose_failure"](spark, d).collect()
    assert len(rows) == 5 * 8
    assert {r["cell_id"]: r["reason"] for r in rows if r["year"] is None} == {
        1: "fitted",
        2: "gev not fitted: variance<1e-08",
        3: "gev not fitted: values=20<30",
        4: "gev not fitted: zero_share>0.95, positive=0<10, variance<1e-08",
        5: "gev not fitted: values=0<30, zero_share>0.95, positive=0<10",
    }
    assert {r["reason"] for r in rows if r["year"] and r["cell_id"] == 1} == {"gev not fitted: values=12<30"}


def test_other_reasons_of_failure(spark):
    rows = [(cell, float(v - 5 * (cell == 2))) for cell in (1, 2) for v in range(1, 41)]
    diagnosis = fit.diagnose(spark.createDataFrame(rows, "cell_id long, value double"), ["cell_id"], "value")
    none = spark.createDataFrame([(1, None), (2, None)], "cell_id long, alpha double")
    said = {r["cell_id"]: r["reason"] for r in fit.diagnose_failure(diagnosis, none, ["cell_id"], "gamma").collect()}
    assert said == {1: "gamma not fitted: estimation", 2: "gamma not fitted: negative=4"}


def test_one_pass_of_all_families_equals_family_by_family(spark):
    rng = np.random.default_rng(9)
    rows = [(c, float(v)) for c in range(4) for v in rng.gamma(2.0 + c, 20.0, 60)] + [(9, 1.0), (9, None), (0, float("nan")), (1, 0.0)]
    df = spark.createDataFrame(rows, "cell_id long, value double")
    both = {(r["cell_id"], r["distribution"]): r for r in fit.compare(df, ["cell_id"], "value").collect()}
    assert len(both) == 5 * 5
    for family, names in fit.PARAMS.items():
        p = fit.fit(df, ["cell_id"], "value", family, "lmoments")
        good = {r["cell_id"]: r for r in fit.goodness_of_fit(df, p, ["cell_id"], "value", family).collect()}
        for r in p.collect():
            one = both[r["cell_id"], family]
            for n in names:
                assert one["params"][n] == (None if r[n] is None else pytest.approx(r[n], rel=1e-12))
            for n in ("ks_statistic", "ks_pvalue", "ad_statistic", "aic", "bic"):
                want = good[r["cell_id"]][n]
                assert one[n] == (None if want is None else pytest.approx(want, rel=1e-9, abs=1e-12))


def test_ks_pvalue_by_enumeration():
    """Against the share of samples of three uniform values, cell by cell, and between the two exact forms."""
    grid = (np.arange(60) + 0.5) / 60
    x = np.sort(np.stack(np.meshgrid(grid, grid, grid, indexing="ij"), -1).reshape(-1, 3), axis=1)
    i = np.arange(1, 4) / 3
    d = np.maximum(i - x, x - (i - 1 / 3)).max(axis=1)
    for at in (0.3, 0.45, 0.55, 0.7):
        assert fit.np_ks_pvalue(at, 3) == pytest.approx((d >= at).mean(), abs=0.02)
    assert fit.np_ks_pvalue(np.sqrt(4.999 / 84), 84) == pytest.approx(fit.np_ks_pvalue(np.sqrt(5.001 / 84), 84), rel=0.01)


def _skew(x: np.ndarray) -> float:
    n = len(x)
    return float(((x - x.mean()) ** 3).mean() / x.std(ddof=1) ** 3 * math.sqrt(n * (n - 1)) / (n - 2))


def _bent(skew: float, months: int) -> np.ndarray:
    """``months`` values with the given sample skew."""
    z = np.array([NormalDist().inv_cdf((i + 0.5) / months) for i in range(months)])
    low, high = -1.0, 1.0
    for _ in range(80):
        c = (low + high) / 2
        low, high = (c, high) if _skew(z + c * z * z) < skew else (low, c)
    return 500 + 60 * (z + c * z * z)


def _pearson3_probability(x: float, skew: float, mean: float, sd: float) -> float:
    """By the sum of the Gamma density over fine steps."""
    w = (x - mean) / sd
    if abs(skew) < 0.01:
        return (1 + math.erf(w / math.sqrt(2))) / 2
    a = 4 / skew**2
    t = np.linspace(max(a - 12 * math.sqrt(a), 1e-9), a + 2 * w / skew, 200_001)
    low = float(np.trapezoid(np.exp((a - 1) * np.log(t) - t - math.lgamma(a)), t))
    return low if skew > 0 else 1 - low


def test_pearson3_probabilities_of_all_cells_and_months(spark, tmp_path):
    skews = {1: 0.012, 2: 0.02, 3: 0.035, 4: 0.049, 5: -0.03, 6: 0.3, 7: -0.4, 8: 0.004}
    cells = {cell: [None, *_bent(skew, 80), None, None, None] for cell, skew in skews.items()} | {9: [None] * 84}
    got = {(r["cell_id"], r["time"]): r["cdf"] for r in QUERIES["dst4_pearson3_cdf"](spark, _ship(tmp_path, cells)).collect()}
    assert set(got) == {(cell, at.date().replace(day=1)) for cell in cells for at in MONTHS}
    for cell, values in cells.items():
        valued = np.array([v for v in values if v is not None])
        if len(valued):
            assert _skew(valued) == pytest.approx(skews[cell], abs=1e-9)
        for at, v in zip(MONTHS, values):
            p = got[cell, at.date().replace(day=1)]
            assert (p is None) == (v is None)
            if v is not None:
                assert p == pytest.approx(_pearson3_probability(v, _skew(valued), valued.mean(), valued.std(ddof=1)), abs=1e-6)


SF = "/root/testdata/sf0.001"
NEW = (
    "dst1c_gamma_mle", "dst4_pearson3_cdf", "dst5a_log_logistic_mle", "dst13_goodness_of_fit", "dst14_compare_distributions", "dst15_select_best",
    "dst16_diagnose", "dst17_diagnose_failure", "idx4_spei_multi_scale", "idx8_spei_pearson3_pooled", "idx8_spi_gev", "idx8_spei_pearson3",
    "idx8_spi_log_logistic", "idx13_spi_daily", "agg3_zero_share", "cal1_366", "cal5_densify_daily", "vis1_index_bars", "vis4_event_timeline",
)


@pytest.mark.parametrize("name", NEW)
def test_queries_equal_their_sql(spark, name):
    """Row for row at the smallest size, numbers to the last rounded place but one."""
    import duckdb

    from climext.queries import ORACLES

    con = duckdb.connect()
    for t in ("lineitem", "supplier", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    rows = lambda of: sorted((tuple(of(r, c) for c in names) for r in pairs), key=str)
    plain = lambda v: None if v is None or v != v else round(v, 3) + 0.0 if isinstance(v, float) else str(v)[:10]
    pairs = got.collect()
    mine = rows(lambda r, c: plain(r[c]))
    cursor = con.execute(ORACLES[name])
    at = {d[0]: i for i, d in enumerate(cursor.description)}
    assert sorted(at) == names
    pairs = cursor.fetchall()
    want = rows(lambda r, c: plain(r[at[c]]))
    assert len(mine) == len(want)
    off = sum(a != b for a, b in zip(mine, want, strict=True))
    assert off <= 0.001 * len(want), [(a, b) for a, b in zip(mine, want, strict=True) if a != b][:3]


@pytest.mark.parametrize("name", ("agg4_lmoments", "agg16_corr", "dst1a_gamma_moments", "dst3c_pearson3_mle", "dst16_diagnose"))
def test_months_of_all_cells_are_not_broadcast(spark, name):
    """A filter on the values makes the join with them an inner one, whose exploded side looks as small as the cells."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastExchange[^\n]*\n[^\n]*Generate explode", plan)
    assert "SortMergeJoin [cell_id" in plan


@pytest.mark.parametrize(
    "name",
    (
        "agg5_lmoment_ratios",
        "dst14_compare_distributions",
        "dst15_select_best",
        "dst1b_gamma_lmoments",
        "dst3b_pearson3_lmoments",
        "dst5c_log_logistic_lmoments",
        "dst7a_gev_lmoments",
        "dst7b_gev_mle",
        "dst9a_gen_logistic_lmoments",
        "dst13_goodness_of_fit",
        "dst16_diagnose",
        "dst1a_gamma_moments",
        "dst3a_pearson3_moments",
        "dst5a_log_logistic_mle",
    ),
)
def test_nor_are_they_by_other_fits(spark, name):
    test_months_of_all_cells_are_not_broadcast(spark, name)
