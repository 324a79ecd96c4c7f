import datetime as dt

from pyspark.sql import functions as F

from hubrisk.operators import pairs as PR
from hubrisk.operators import risk as RK


def _corr_fixture(spark, values_a, values_b):
    rows, dates = [], []
    for i, (a, b) in enumerate(zip(values_a, values_b)):
        d = dt.date(2024, 3, 1) + dt.timedelta(days=i)
        dates.append((d, 3))
        rows += [("AAA", d, a, 10.0 + i), ("BBB", d, b, 20.0 + 2 * i)]
    daily = spark.createDataFrame(rows, "airport string, date date, precip_total double, wind_gusts_max double")
    dates = spark.createDataFrame(dates, "date date, month int")
    ranked = spark.createDataFrame([("AAA", 1, 2), ("BBB", 2, 2)], "airport string, rk int, n int")
    spine = spark.createDataFrame([("AAA", "BBB", 3)], "airport_a string, airport_b string, month int")
    return daily, dates, ranked, spine


def test_dry_month_correlation_is_zero(spark, params):
    daily, dates, ranked, spine = _corr_fixture(spark, [0.0] * 8, [0.0] * 8)
    r = PR.pair_weather_corr(daily, dates, ranked, spine, params).first()
    assert r.precip_correlation == 0.0 and abs(r.wind_correlation - 1.0) < 1e-9


def test_correlation_needs_more_than_five_days(spark, params):
    daily, dates, ranked, spine = _corr_fixture(spark, [1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 4.0, 6.0, 8.0, 11.0])
    assert PR.pair_weather_corr(daily, dates, ranked, spine, params).first().precip_correlation == 0.0
    daily, dates, ranked, spine = _corr_fixture(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [2.0, 4.0, 6.0, 8.0, 10.0, 12.0])
    assert abs(PR.pair_weather_corr(daily, dates, ranked, spine, params).first().precip_correlation - 1.0) < 1e-9


def test_joint_denominator_counts_days_without_flights(make_flights, params):
    from tests.conftest import flight
    rows = []
    for day in range(1, 11):
        date = f"2024-03-{day:02d}"
        rows.append(flight(f"a{day}", date, "AAA", "HUB", wx=5.0 if day <= 2 else 0.0))
        if day <= 5:
            rows.append(flight(f"b{day}", date, "BBB", "HUB", wx=5.0 if day == 1 else 0.0))
    r = PR.pair_joint_delay(make_flights(rows), params).first()
    assert r.n_overlap_days == 10
    assert abs(r.joint_weather_delay_prob - 0.1) < 1e-12 and abs(r.conditional_delay_prob - 0.5) < 1e-12


def test_unmapped_regions_count_as_same(spark):
    air = spark.createDataFrame([("X", 30.0, -90.0, None, True, False, False), ("Y", 31.0, -91.0, None, True, True, False)],
                                "iata string, latitude double, longitude double, region string, in_tornado boolean, "
                                "in_gulf boolean, in_winter boolean")
    pairs = spark.createDataFrame([("X", "Y"), ("X", "Z")], "airport_a string, airport_b string")
    got = {r.airport_b: r for r in PR.pair_geography(pairs, air).collect()}
    assert got["Y"].same_region == 1 and got["Y"].tornado_alley_pair == 1 and got["Y"].hurricane_pair == 0
    assert got["Z"].distance_ab is None and got["Z"].same_region == 1


def test_constant_feature_normalises_to_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0)], "x double, c double")
    rows = RK.minmax_normalize(df, ["x", "c"]).orderBy(F.col("x").asc_nulls_first()).collect()
    assert [r.x_norm for r in rows] == [0.0, 0.5, 1.0] and {r.c_norm for r in rows} == {0.0}


def test_competition_rank_ties(spark):
    df = spark.createDataFrame([("a", 9.0), ("b", 9.0), ("c", 5.0)], "k string, s double")
    got = {r.k: r.r for r in RK.competition_rank(df, "s", "r").collect()}
    assert got == {"a": 1, "b": 1, "c": 3}


def test_risk_score_range_and_top_rank(spark):
    from hubrisk.params import SCORE_FEATURES
    rows = [tuple(float((i * 7 + j * 3) % 11) for j in range(len(SCORE_FEATURES))) for i in range(30)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in SCORE_FEATURES))
    out = RK.risk_scores(df).collect()
    assert min(r.risk_score for r in out) >= 0 and max(r.risk_score for r in out) <= 100
    assert all(r.risk_score == 100.0 for r in out if r.risk_rank == 1)


def test_day_bitmaps_equal_a_plain_count(make_flights, spark, params):
    """Joint delays and co-occurrences over years and months, first and last days, against loops over the dates."""
    import datetime as dt
    import random
    from collections import defaultdict
    from tests.conftest import flight
    rnd = random.Random(8)
    dates = [dt.date(y, m, d) for y in (2019, 2021, 2024) for m in (1, 2) for d in (1, 2, 3, 15, 28, 29, 30, 31)
             if m == 1 or d <= 28 or (d == 29 and y == 2024)]
    rows, wx, late, seen = [], defaultdict(set), defaultdict(set), defaultdict(set)
    for i in range(400):
        a, d = rnd.choice(["AAA", "AAA", "BBB", "CCC"]), rnd.choice(dates)
        w, delay = rnd.choice([None, 0.0, 9.0]), rnd.choice([None, 0.0, 15.0, 40.0])
        rows.append(flight(f"f{i}", str(d), a, "HUB", wx=w, dep_delay=delay))
        seen[d.month].add(d)
        if w:
            wx[a].add(d)
        if delay and delay > 15:
            late[a].add(d)
    fl = make_flights(rows)
    got = {(r.airport_a, r.airport_b, r.month): r for r in PR.pair_joint_delay(fl, params).collect()}
    assert len(got) == 6
    for (a, b, m), r in got.items():
        of = lambda s, m=m: {d for d in s if d.month == m}
        n, both = len(seen[m]), len(of(wx[a] & wx[b]))
        assert r.n_overlap_days == n and abs(r.joint_weather_delay_prob - both / n) < 1e-12
        assert abs(r.joint_delay_15_prob - len(of(late[a] & late[b])) / n) < 1e-12
        assert abs(r.conditional_delay_prob - (both / len(of(wx[a])) if of(wx[a]) else 0.0)) < 1e-12
    daily = spark.createDataFrame([(a, d, float(rnd.randrange(2)), None) for a in ("AAA", "CCC") for d in dates + [dt.date(2019, 5, 1)]],
                                  "airport string, date date, x double, y double")
    spine = PR.pair_spine(fl, params)
    from hubrisk.operators.flights import flight_dates
    hits = {(r.airport, r.date) for r in daily.where("x > 0").collect()}
    for r in PR.pair_cooccurrence(daily, {"cx": "x", "cy": "y"}, flight_dates(fl), spine).collect():
        both = [d for d in seen[r.month] if (r.airport_a, d) in hits and (r.airport_b, d) in hits]
        assert abs(r.cx - len(both) / len(seen[r.month])) < 1e-12 and r.cy == 0.0


def test_weights_from_an_importance_table_equal_those_of_a_dict(spark):
    known = {"conditional_delay_prob": 0.4, "joint_weather_delay_prob": 0.1, "wx_hub_precip": 0.5}
    rows = spark.createDataFrame(list(known.items()), "feature string, importance double")
    weights = RK.importance_weights(rows)
    assert weights == RK.importance_weights(known) and abs(sum(weights.values()) - 1.0) < 1e-12
    assert weights["conditional_delay_prob"] > weights["joint_weather_delay_prob"] > weights["thunderstorm_co_occurrence"]
