import random

import pytest

from hubrisk.operators import sequences as SQ
from tests.conftest import flight


def test_sequence_gap_bounds_and_same_airport(make_flights, params):
    fl = make_flights([
        flight("i1", "2024-03-01", "AAA", "HUB", crs=1000.0, arr_delay=20.0, wx=5.0),
        flight("o59", "2024-03-01", "HUB", "BBB", crs=1059.0, dep_delay=30.0),
        flight("o60", "2024-03-01", "HUB", "CCC", crs=1100.0, dep_delay=30.0),
        flight("oA", "2024-03-01", "HUB", "AAA", crs=1300.0, dep_delay=30.0),
    ])
    rows = SQ.sequences(fl, params).collect()
    assert [(r.in_flight_id, r.out_flight_id, r.connection_minutes, r.cascading_delay) for r in rows] == [("i1", "o60", 60, 1)]


def test_cancelled_leg_kept_not_cascading(make_flights, params):
    fl = make_flights([
        flight("i1", "2024-03-01", "AAA", "HUB", crs=800.0, arr_delay=None, wx=0.0, late=9.0),
        flight("o1", "2024-03-01", "HUB", "BBB", crs=1200.0, dep_delay=99.0),
    ])
    r = SQ.sequences(fl, params).first()
    assert r.inbound_arr_delay is None and r.cascading_delay == 0


def test_cascade_gap_bounds(make_flights, params):
    rows = [flight("i1", "2024-03-01", "AAA", "HUB", crs=100.0, arr_delay=600.0, wx=10.0)]
    for gap in (44, 45, 480, 481):
        m = 60 + gap
        rows.append(flight(f"o{gap}", "2024-03-01", "HUB", f"B{gap}", crs=float((m // 60) * 100 + m % 60), dep_delay=5.0))
    got = sorted(r.gap_minutes for r in SQ.cascade_events(make_flights(rows), params).collect())
    assert got == [45, 480]


def test_cascade_propagated_and_total(make_flights, params):
    fl = make_flights([flight("i1", "2024-03-01", "AAA", "HUB", crs=1000.0, arr_delay=100.0, wx=30.0),
                       flight("o1", "2024-03-01", "HUB", "BBB", crs=1100.0, dep_delay=10.0, wx=7.0)])
    r = SQ.cascade_events(fl, params).first()
    assert (r.propagated_delay, r.total_cascade_minutes, r.pair_a, r.pair_b) == (40.0, 47.0, "AAA", "BBB")


def _sequential_greedy(inb, outb, turnaround=60):
    """The reference loop: inbound by (arrival, id) takes the earliest unused feasible outbound."""
    used, out = set(), []
    outs = sorted(outb, key=lambda o: (o[2], o[0]))
    for fid, ap, arr in sorted(inb, key=lambda i: (i[2], i[0])):
        for oid, dest, dep in outs:
            if oid in used:
                continue
            if dep - arr >= turnaround:
                used.add(oid)
                if ap != dest:
                    out.append((fid, oid))
                break
    return out


def test_greedy_tie_lower_id_wins(make_flights, params):
    fl = make_flights([flight("i2", "2024-03-01", "AAA", "HUB", crs=800.0, wx=5.0),
                       flight("i1", "2024-03-01", "CCC", "HUB", crs=800.0, wx=5.0),
                       flight("o1", "2024-03-01", "HUB", "BBB", crs=1000.0, dep_delay=20.0)])
    got = [(r.in_flight_id, r.out_flight_id) for r in SQ.greedy_assignment(fl, params).collect()]
    assert got == [("i1", "o1")]


def test_greedy_same_airport_consumes_outbound(make_flights, params):
    fl = make_flights([flight("i1", "2024-03-01", "BBB", "HUB", crs=800.0, wx=5.0),
                       flight("i2", "2024-03-01", "CCC", "HUB", crs=805.0, wx=5.0),
                       flight("o1", "2024-03-01", "HUB", "BBB", crs=1000.0, dep_delay=20.0)])
    assert SQ.greedy_assignment(fl, params).count() == 0


def test_greedy_windows_equal_sequential_loop(make_flights, params):
    rnd = random.Random(7)
    rows, expected = [], set()
    for day in range(1, 29):
        date = f"2024-02-{day:02d}"
        inb = [(f"d{day}i{k:02d}", f"A{rnd.randint(0, 4)}", rnd.choice(range(0, 1380, 15))) for k in range(rnd.randint(0, 12))]
        outb = [(f"d{day}o{k:02d}", f"A{rnd.randint(0, 4)}", rnd.choice(range(0, 1440, 15))) for k in range(rnd.randint(0, 12))]
        for fid, ap, arr in inb:
            rows.append(flight(fid, date, ap, "HUB", crs=float((arr // 60) * 100 + arr % 60), wx=1.0))
        for fid, ap, dep in outb:
            rows.append(flight(fid, date, "HUB", ap, crs=float((dep // 60) * 100 + dep % 60), dep_delay=16.0))
        expected |= set(_sequential_greedy(inb, outb))
    for width in (60, 7):
        p = params.__class__(**{**params.__dict__, "time_bin_minutes": width})
        got = {(r.in_flight_id, r.out_flight_id) for r in SQ.greedy_assignment(make_flights(rows), p).collect()}
        assert got == expected


def test_salted_range_join_same_result(make_flights, params):
    rnd = random.Random(3)
    rows = []
    for k in range(60):
        m = rnd.randint(0, 1439)
        rows.append(flight(f"i{k}", "2024-05-05", f"A{k % 5}", "HUB", crs=float((m // 60) * 100 + m % 60), arr_delay=30.0))
        m = rnd.randint(0, 1439)
        rows.append(flight(f"o{k}", "2024-05-05", "HUB", f"A{k % 7}", crs=float((m // 60) * 100 + m % 60), dep_delay=30.0))
    fl = make_flights(rows)
    base = {tuple(r) for r in SQ.sequences(fl, params).collect()}
    salted = params.__class__(**{**params.__dict__, "salt_buckets": 4, "time_bin_minutes": 30})
    assert {tuple(r) for r in SQ.sequences(fl, salted).collect()} == base


def test_replicated_side_choice_same_result(make_flights, params):
    rnd = random.Random(5)
    rows = []
    for k in range(80):
        m = rnd.randint(0, 1439)
        rows.append(flight(f"i{k}", "2024-05-06", f"A{k % 6}", "HUB", crs=float((m // 60) * 100 + m % 60),
                           arr_delay=float(rnd.randint(0, 500)), wx=5.0))
        m = rnd.randint(0, 1439)
        rows.append(flight(f"o{k}", "2024-05-06", "HUB", f"A{k % 5}", crs=float((m // 60) * 100 + m % 60),
                           dep_delay=float(rnd.randint(1, 90)), wx=1.0))
    fl = make_flights(rows)
    inb = SQ._inbound_legs(fl, params)
    outb = SQ._outbound_legs(fl, params)
    for lo, hi in ((60, None), (45, 480)):
        results = []
        for side in ("in", "out"):
            for salt in (1, 3):
                p = params.__class__(**{**params.__dict__, "salt_buckets": salt, "time_bin_minutes": 45})
                j = SQ.same_day_range_join(inb, outb, "inbound_arr_time", "outbound_dep_time", lo, hi, p, side)
                results.append(sorted((r.in_flight_id, r.out_flight_id) for r in j.collect()))
        assert all(r == results[0] for r in results) and results[0]


def test_totals_without_pairs_equal_the_pairs(make_flights, params):
    """Odd minutes, shared minutes, airports on both sides, missing delays, days at the year's ends."""
    rnd = random.Random(11)
    fl = []
    for i in range(500):
        spoke = rnd.choice(["AAA", "BBB", "CCC", "DDD", None])
        day = rnd.choice(["2019-12-31", "2024-01-01", "2024-01-02", "2024-07-09"])
        crs = rnd.choice([None, 0.0, 5.0, 59.0, 1000.0, 1059.0, 1100.0, 1159.0, 2359.0, 2400.0, float(rnd.randrange(24) * 100 + rnd.randrange(60))])
        delay = rnd.choice([None, 0.0, 15.0, 16.0, 90.0])
        ends = (spoke, "HUB") if rnd.random() < 0.5 else ("HUB", spoke)
        fl.append(flight(f"f{i}", day, *ends, crs=crs, arr_delay=delay, dep_delay=delay, wx=rnd.choice([None, 0.0, 3.0]), late=rnd.choice([None, 0.0, 2.0])))
    flights = make_flights(fl)
    keys = ["year", "month", "cascading_delay"]
    want = {tuple(r)[:3]: r["count"] for r in SQ.sequences(flights, params).groupBy(*keys).count().collect()}
    got = {(r.year, r.month, r.cascading_delay): r.weight for r in SQ.sequence_totals(flights, params).collect()}
    assert got == want and len(want) > 4
    counted = {}
    for r in SQ.sequence_counts(flights.dropna(subset=["Origin", "Dest"]), params).collect():
        k = (r.year, r.month, r.cascading_delay)
        counted[k] = counted.get(k, 0) + r.weight
    assert counted == want
    assert SQ.sequence_totals(flights.limit(0), params).count() == 0
    assert "Join" not in SQ.sequence_totals(flights, params)._jdf.queryExecution().optimizedPlan().toString()


def test_salts_follow_the_counted_pairs(make_flights, params, spark):
    """90 % of the flights in one bin: its pairs spread evenly over tasks, other keys stay whole, rows are the same."""
    from pyspark.sql import functions as F
    rnd = random.Random(12)
    rows = []
    for k in range(1200):
        hot = rnd.random() < 0.9
        t = rnd.randrange(600, 660) if hot else rnd.randrange(1440)
        rows.append(flight(f"i{k}", "2024-05-05", f"A{k % 5}", "HUB", crs=float((t // 60) * 100 + t % 60), arr_delay=300.0, wx=3.0))
        t = rnd.randrange(720, 780) if hot else rnd.randrange(1440)
        rows.append(flight(f"o{k}", "2024-05-05", "HUB", f"B{k % 7}", crs=float((t // 60) * 100 + t % 60), dep_delay=30.0))
    fl = make_flights(rows)
    inb, outb = SQ._inbound_legs(fl, params), SQ._outbound_legs(fl, params)
    for side in ("in", "out"):
        results = []
        for most in (None, 4_000_000, 5_000):
            p = params.__class__(**{**params.__dict__, "pairs_per_key": most})
            j = SQ.same_day_range_join(inb, outb, "inbound_arr_time", "outbound_dep_time", 60, None, p, side)
            results.append(j)
        want = results[0].select("in_flight_id", "out_flight_id")
        for j in results[1:]:
            assert j.columns == results[0].columns and j.count() == want.count()
            assert j.select("in_flight_id", "out_flight_id").exceptAll(want).count() == 0
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            tasks = sorted(r["count"] for r in results[2].groupBy(F.spark_partition_id()).count().collect())
            before = sorted(r["count"] for r in results[0].groupBy(F.spark_partition_id()).count().collect())
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert len(tasks) == 8 and tasks[-1] <= 2 * tasks[len(tasks) // 2] < before[-1]
    assert SQ.hot_bins(inb.limit(0).withColumn("_bin", F.lit(1)), outb.withColumn("_bin", F.lit(1)), 1) is None


def test_worst_cascade_day_counts_minutes_not_flights(make_flights, params):
    from hubrisk.operators import casestudy as CS
    from tests.conftest import flight
    hub = params.hub
    # many weather-delayed arrivals that delay nothing, against one that costs much
    many = [flight(f"a{i}", "2024-03-01", "AAA", hub, crs=600.0 + i, arr_delay=20.0, wx=20.0) for i in range(5)]
    one = [flight("b", "2024-03-02", "AAA", hub, crs=600.0, arr_delay=200.0, wx=200.0),
           flight("c", "2024-03-02", hub, "BBB", crs=730.0, dep_delay=120.0)]
    f = make_flights(many + one)
    assert str(CS.worst_day(f, params).first().date) == "2024-03-01"
    worst = CS.worst_cascade_day(f, params).first()
    assert (str(worst.date), worst.cascades, worst.propagated_delay, worst.total_cascade_minutes) == ("2024-03-02", 1, 110.0, 230.0)
    assert CS.cascade_impact_by_day(make_flights([]), params).count() == 0


def test_cascade_totals_equal_paired_events(make_flights, params):
    pick = random.Random(7)
    values = [0.0, 5.0, 50.0, 45.0, 60.5, 120.0, 480.0, 600.0, -30.0, None]
    rows = []
    for i in range(400):
        spoke = pick.choice(["A", "B", "C", None])
        inbound = pick.random() < 0.5
        odd = float("nan") if i == 7 else float("inf") if i == 8 else pick.choice(values)
        rows.append(flight(f"f{i % 390}", pick.choice(["2019-01-01", "2019-01-02", "2019-02-01"]), *((spoke, "HUB") if inbound else ("HUB", spoke)),
                           pick.choice([None, *(100.0 * h + m for h in range(24) for m in (0, 15, 59))]), odd,
                           pick.choice(values), pick.choice(values), pick.choice(values)))
    df = make_flights(rows)
    got = {r[:3]: r[3:] for r in map(tuple, SQ.cascade_totals(df, params).collect())}
    want = {r[:3]: r[3:] for r in map(tuple, SQ.cascade_propagation(SQ.cascade_events(df, params), params).collect())}
    assert got.keys() == want.keys() and len(want) > 4
    for k, v in want.items():
        assert got[k] == pytest.approx(v, nan_ok=True), k
    assert SQ.cascade_totals(make_flights([]), params).count() == 0


def test_enriched_joins_carry_few_columns_and_legs_are_finished_before(make_flights, params, spark):
    from pyspark.sql import functions as F
    measures = [f"m{k}" for k in range(30)]
    rows = [flight("i1", "2024-03-01", "AAA", "HUB", crs=600.0, arr_delay=20.0, wx=5.0), flight("i2", "2024-03-01", "CCC", "HUB", crs=700.0, arr_delay=None),
            flight("o1", "2024-03-01", "HUB", "BBB", crs=900.0, dep_delay=30.0), flight("o2", "2024-03-01", "HUB", "AAA", crs=900.0, dep_delay=30.0)]
    fl = make_flights(rows)
    days = [(a, k) for k, a in enumerate(("AAA", "HUB", "BBB"))]
    daily = spark.createDataFrame(days, "airport string, k int").select(
        "airport", F.lit("2024-03-01").cast("date").alias("date"), *[(F.col("k") * 100.0 + i).alias(m) for i, m in enumerate(measures)])
    pairs = spark.createDataFrame([("BBB", "AAA", 3, 0.5)], "airport_a string, airport_b string, month int, risk double")
    marked = lambda df: df.withColumns({c: F.col(c) + 1000 for c in ("inbound_arr_delay", "outbound_dep_delay") if c in df.columns})
    out = SQ.sequences_enriched(fl, pairs, daily, params, marked)
    assert out.columns[:3] == ["month", "date", "year"] and out.columns[-4:] == ["hour_sin", "hour_cos", "dow_sin", "dow_cos"]
    got = {(r.in_flight_id, r.out_flight_id): r for r in out.collect()}
    assert set(got) == {("i1", "o1"), ("i2", "o1"), ("i2", "o2")}
    r = got["i1", "o1"]
    assert (r.cascading_delay, r.inbound_arr_delay, r.outbound_dep_delay) == (1, 1020.0, 1030.0)  # judged before, copied after
    assert (r.wx_a_m3, r.wx_hub_m3, r.wx_b_m3, r.risk, r.pair_airport_a) == (3.0, 103.0, 203.0, 0.5, "BBB")
    assert got["i2", "o2"].risk is None and got["i2", "o2"].wx_a_m3 is None and got["i2", "o2"].wx_b_m3 == 3.0
    plain = SQ.enriched_rows(SQ.sequences(fl, params), pairs, daily, params)
    assert sorted(map(str, (r.asDict() for r in plain.select(*out.columns).collect()))) == sorted(
        str(r.asDict()) for r in SQ.sequences_enriched(fl, pairs, daily, params).collect())
    plan = out._jdf.queryExecution().optimizedPlan()
    joined, todo = [], [plan]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "Join":
            names = [node.output().apply(k).name() for k in range(node.output().size())]
            if "airport_a" in names and "airport_b" in names:
                joined.append(len(names))
    assert joined and max(joined) < 20  # pairs of flights: not the 90 weather columns one by one
