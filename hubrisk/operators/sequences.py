"""Hub connection operators: flight-weather join, A->hub->B sequences, cascade range join,
airport-day cascade events, greedy one-to-one matching, enrichment (C1-C5, C9, C15).

Same-day range joins are equi-joins on (date, time bin): the outbound side sits in one
bin of width ``Params.time_bin_minutes``; each inbound row is replicated over the bins its
window can reach, so a busy day spreads over many join keys instead of one task. A (date, bin)
whose counted pairs exceed ``Params.pairs_per_key`` is salted into as many keys as its count asks for:
one side is dealt to the salts by hash, the other copied to each. Days without a hot bin are joined as
they are. ``Params.salt_buckets > 1`` salts every key alike instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubrisk.functions.exprs import (cyclic_cos, cyclic_sin, direction, flag, hhmm_to_minutes,
                                     pair_hi, pair_lo, spoke_airport)
from hubrisk.operators.common import written
from hubrisk.params import Params

DAY_MINUTES = 1440
HOT_BROADCAST = 100_000  # counted (date, bin) rows up to which the table of hot keys is broadcast
MINUTE_COUNTS = ("n_in", "hit_in", "n_out", "hit_out")


def _bin(t, width: int, cap: int):
    return F.least(F.greatest(F.floor(t / width), F.lit(0)), F.lit(cap)).cast("int")


def same_day_range_join(inbound: DataFrame, outbound: DataFrame, t_in: str, t_out: str,
                        lo: int, hi: int | None, p: Params, replicate: str = "in",
                        narrow: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Pairs (inbound, outbound) of the same ``date`` with lo <= t_out - t_in <= hi (hi None: unbounded).

    One side sits in exactly one time bin; the other is replicated over the bins its window
    can reach, so every matching pair meets in exactly one (date, bin) key. ``replicate``
    names the replicated side ("in" or "out"): the one with the smaller rows, where they differ.
    ``narrow``: the same rows before wide columns were joined to them, to count bins from."""
    width = max(1, int(p.time_bin_minutes))
    cap = DAY_MINUTES // width + 1
    def binned(i: DataFrame, o: DataFrame) -> tuple[DataFrame, DataFrame]:
        if replicate == "in":
            start = _bin(F.col(t_in) + lo, width, cap)
            end = F.lit(cap) if hi is None else _bin(F.col(t_in) + hi, width, cap)
            return i.withColumn("_bin", F.explode(F.sequence(start, end))), o.withColumn("_bin", _bin(F.col(t_out), width, cap))
        start = F.lit(0) if hi is None else _bin(F.col(t_out) - hi, width, cap)
        end = _bin(F.col(t_out) - lo, width, cap)
        return i.withColumn("_bin", _bin(F.col(t_in), width, cap)), o.withColumn("_bin", F.explode(F.sequence(start, F.greatest(start, end))))
    inb, outb = binned(inbound, outbound)
    keys = ["date", "_bin"]
    if p.salt_buckets == 1 and p.pairs_per_key is not None:
        hot = hot_bins(*binned(*(narrow or (inbound, outbound))), p.pairs_per_key)
        if hot is not None:
            salts = F.coalesce("_salts", F.lit(1))

            def salted(df: DataFrame, columns: list[str], deal: bool) -> DataFrame:
                salt = F.pmod(F.xxhash64(*columns), salts).cast("int") if deal else F.explode(F.sequence(F.lit(0), salts - 1))
                return df.join(hot, keys, "left").withColumn("_salt", salt).drop("_salts")
            inb = salted(inb, inbound.columns, replicate == "in")
            outb = salted(outb, outbound.columns, replicate != "in")
            keys = [*keys, "_salt"]
    elif p.salt_buckets > 1:
        # split the bin-replicated side by a hash salt; copy the single-bin side once per salt
        n = p.salt_buckets
        salt = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        if replicate == "in":
            inb = inb.withColumn("_salt", F.pmod(F.xxhash64(*inbound.columns), F.lit(n)).cast("int"))
            outb = outb.withColumn("_salt", salt)
        else:
            outb = outb.withColumn("_salt", F.pmod(F.xxhash64(*outbound.columns), F.lit(n)).cast("int"))
            inb = inb.withColumn("_salt", salt)
        keys.append("_salt")
    gap = F.col(t_out) - F.col(t_in)
    cond = gap >= lo if hi is None else gap.between(lo, hi)
    return inb.join(outb, keys, "inner").where(cond).drop(*keys[1:])


def hot_bins(inb: DataFrame, outb: DataFrame, most: int) -> DataFrame | None:
    """``date, _bin, _salts`` of the join keys with more than ``most`` pairs, counted from both sides; None if
    there are none. The histogram has one row per date and bin; hot keys are broadcast if they are few."""
    n = (inb.groupBy("date", "_bin").agg(F.count(F.lit(1)).alias("_n_in"))
         .join(outb.groupBy("date", "_bin").agg(F.count(F.lit(1)).alias("_n_out")), ["date", "_bin"]))
    salts = F.ceil(F.col("_n_in") * F.col("_n_out") / most).cast("int")
    hot = n.withColumn("_salts", salts).where(F.col("_salts") > 1).select("date", "_bin", "_salts")
    hot = written(hot, "hot-bins")
    found = hot.count()
    return None if found == 0 else F.broadcast(hot) if found <= HOT_BROADCAST else hot


def flights_weather(flights: DataFrame, daily: DataFrame, p: Params) -> DataFrame:
    """Each flight with the hub's daily weather (hub_*) and the spoke's (other_*)."""
    measures = [c for c in daily.columns if c not in ("airport", "date")]
    hub = daily.where(F.col("airport") == p.hub).select(
        "date", *[F.col(c).alias(f"hub_{c}") for c in measures])
    other = daily.select(F.col("airport").alias("other_airport"), "date",
                         *[F.col(c).alias(f"other_{c}") for c in measures])
    base = flights.withColumns({"date": F.col("FlightDate"), "other_airport": spoke_airport(p.hub),
                                "direction": direction(p.hub)})
    return base.join(hub, "date", "left").join(other, ["other_airport", "date"], "left")


def _inbound_legs(flights: DataFrame, p: Params) -> DataFrame:
    return (flights.where((F.col("Dest") == p.hub) & F.col("CRSArrTime").isNotNull())
            .select(F.col("flight_id").alias("in_flight_id"), F.col("FlightDate").alias("date"),
                    F.col("Origin").alias("airport_a"), hhmm_to_minutes("CRSArrTime").alias("inbound_arr_time"),
                    F.col("ArrDelay").alias("inbound_arr_delay"),
                    F.col("WeatherDelay").alias("inbound_weather_delay"),
                    F.col("LateAircraftDelay").alias("inbound_late_aircraft_delay")))


def _outbound_legs(flights: DataFrame, p: Params) -> DataFrame:
    return (flights.where((F.col("Origin") == p.hub) & F.col("CRSDepTime").isNotNull())
            .select(F.col("flight_id").alias("out_flight_id"), F.col("FlightDate").alias("date"),
                    F.col("Dest").alias("airport_b"), hhmm_to_minutes("CRSDepTime").alias("outbound_dep_time"),
                    F.col("DepDelay").alias("outbound_dep_delay"),
                    F.col("WeatherDelay").alias("outbound_weather_delay")))


def _as_is(df: DataFrame) -> DataFrame:
    return df


def _sequence_legs(flights: DataFrame, p: Params, finish: Callable[[DataFrame], DataFrame],
                   inbound_more: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both legs with all that a sequence takes from one of them, so that a pair of flights has little left to
    compute: calendar fields and ``_hit_in`` inbound, ``_hit_out`` outbound."""
    th = p.delay_threshold
    inb = _inbound_legs(flights, p).withColumns({
        "month": F.month("date"), "year": F.year("date"), "day_of_week": F.weekday("date") + 1,
        "_hit_in": flag(F.col("inbound_arr_delay") > th) & flag(
            (F.col("inbound_weather_delay") > 0) | (F.col("inbound_late_aircraft_delay") > 0))})
    outb = _outbound_legs(flights, p).withColumn("_hit_out", flag(F.col("outbound_dep_delay") > th))
    return finish(inb.withColumns(inbound_more or {})), finish(outb)


def _sequence_pairs(inb: DataFrame, outb: DataFrame, flights: DataFrame, p: Params, replicate: str) -> DataFrame:
    return (same_day_range_join(inb, outb, "inbound_arr_time", "outbound_dep_time", p.min_turnaround, None, p,
                                replicate, (_inbound_legs(flights, p), _outbound_legs(flights, p)))
            .where(F.col("airport_a") != F.col("airport_b")))


def _pair_columns() -> dict[str, Column]:
    """What a pair of legs adds to them."""
    return {"connection_minutes": F.col("outbound_dep_time") - F.col("inbound_arr_time"),
            "cascading_delay": (F.col("_hit_in") & F.col("_hit_out")).cast("int")}


def sequences(flights: DataFrame, p: Params, finish: Callable[[DataFrame], DataFrame] = _as_is) -> DataFrame:
    """Same-day inbound x outbound with gap >= min_turnaround and A != B, labelled cascading.

    ``finish`` is applied to the legs: output types and rounding of the columns that pairs copy."""
    j = _sequence_pairs(*_sequence_legs(flights, p, finish), flights, p, "in")
    return j.withColumns(_pair_columns()).select(*SEQUENCE_COLUMNS)


def sequence_counts(flights: DataFrame, p: Params) -> DataFrame:
    """How many rows of ``sequences`` there are per (year, month, inbound_arr_time, connection_minutes,
    label): the same numbers without a row per flight pair. Legs are counted per (date, minute), the
    counts are joined and multiplied, and pairs of one airport (counted the same way) are subtracted."""
    th = p.delay_threshold
    inb = _inbound_legs(flights, p).withColumn("_hit", flag(F.col("inbound_arr_delay") > th) & flag(
        (F.col("inbound_weather_delay") > 0) | (F.col("inbound_late_aircraft_delay") > 0)))
    outb = _outbound_legs(flights, p).withColumn("_hit", flag(F.col("outbound_dep_delay") > th))

    def joined(same_airport: bool) -> DataFrame:
        def legs(df, airport, minute, n, hits):
            day = F.struct("date", F.col(airport).alias("airport")) if same_airport else F.struct("date")
            return df.groupBy(day.alias("date"), minute).agg(F.count(F.lit(1)).alias(n), F.count_if("_hit").alias(hits))
        i = legs(inb, "airport_a", "inbound_arr_time", "n_in", "hit_in")
        o = legs(outb, "airport_b", "outbound_dep_time", "n_out", "hit_out")
        sign = -1 if same_airport else 1
        j = same_day_range_join(i, o, "inbound_arr_time", "outbound_dep_time", p.min_turnaround, None, replace(p, pairs_per_key=None))
        return j.select(F.year("date.date").alias("year"), F.month("date.date").alias("month"), "inbound_arr_time",
                        (F.col("outbound_dep_time") - F.col("inbound_arr_time")).alias("connection_minutes"),
                        (sign * F.col("n_in") * F.col("n_out")).alias("n"), (sign * F.col("hit_in") * F.col("hit_out")).alias("hits"))
    keys = ["year", "month", "inbound_arr_time", "connection_minutes"]
    total = joined(False).unionByName(joined(True)).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    cells = F.array(F.struct(F.lit(1).alias("cascading_delay"), F.col("hits").alias("weight")),
                    F.struct(F.lit(0).alias("cascading_delay"), (F.col("n") - F.col("hits")).alias("weight")))
    return total.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*").where(F.col("weight") > 0)


def sequence_totals(flights: DataFrame, p: Params) -> DataFrame:
    """``sequence_counts`` without the minutes: rows of ``sequences`` per (year, month, label), as ``weight``.

    No legs are joined. Arrivals, moved on by the turnaround, and departures are counted per minute; the running
    sum of a day's departures from its last minute backwards tells each minute's arrivals how many departures
    they can reach. Pairs of one airport are counted the same way within (date, airport) and taken off. A window
    holds one row per minute of a day, whatever the number of flights."""
    th = p.delay_threshold
    hit_in = flag(F.col("inbound_arr_delay") > th) & flag(
        (F.col("inbound_weather_delay") > 0) | (F.col("inbound_late_aircraft_delay") > 0))
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def events(legs: DataFrame, airport: str, minute: Column, hit: Column, arrives: bool) -> DataFrame:
        n, hits = one, hit.cast("long")
        counts = (n, hits, none, none) if arrives else (none, none, n, hits)
        return legs.select("date", F.col(airport).alias("airport"), minute.alias("minute"),
                           *[c.alias(k) for c, k in zip(counts, MINUTE_COUNTS, strict=True)]).dropna(subset=["date", "airport", "minute"])
    ev = events(_inbound_legs(flights, p), "airport_a", F.col("inbound_arr_time") + p.min_turnaround, hit_in, True).unionByName(
        events(_outbound_legs(flights, p), "airport_b", F.col("outbound_dep_time"), flag(F.col("outbound_dep_delay") > th), False))
    by_airport = ev.groupBy("date", "airport", "minute").agg(*[F.sum(c).alias(c) for c in MINUTE_COUNTS])
    by_day = by_airport.groupBy("date", "minute").agg(*[F.sum(c).alias(c) for c in MINUTE_COUNTS])

    def pairs(counted: DataFrame, part: list[str], sign: int) -> DataFrame:
        later = Window.partitionBy(*part).orderBy(F.desc("minute")).rowsBetween(Window.unboundedPreceding, 0)
        reached = counted.select("date", "n_in", "hit_in", F.sum("n_out").over(later).alias("n_later"), F.sum("hit_out").over(later).alias("hit_later"))
        return reached.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(
            (sign * F.sum(F.col("n_in") * F.col("n_later"))).alias("n"), (sign * F.sum(F.col("hit_in") * F.col("hit_later"))).alias("hits"))
    total = pairs(by_day, ["date"], 1).unionByName(pairs(by_airport, ["date", "airport"], -1)).groupBy(
        "year", "month").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    cells = F.array(F.struct(F.lit(1).alias("cascading_delay"), F.col("hits").alias("weight")),
                    F.struct(F.lit(0).alias("cascading_delay"), (F.col("n") - F.col("hits")).alias("weight")))
    return total.select("year", "month", F.explode(cells).alias("c")).select("year", "month", "c.*").where(F.col("weight") > 0)


def _cascade_legs(flights: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Weather-delayed inbound and delayed outbound legs."""
    inb = (_inbound_legs(flights, p)
           .where(F.col("inbound_arr_delay").isNotNull() & (F.col("inbound_weather_delay") > 0)))
    outb = (_outbound_legs(flights, p)
            .where(F.col("outbound_dep_delay").isNotNull() & (F.col("outbound_dep_delay") > 0)))
    return inb, outb


def cascade_events(flights: DataFrame, p: Params) -> DataFrame:
    """Weather-delayed inbound x delayed outbound, same day, gap in [gap_min, gap_max], A != B;
    propagated = max(0, ArrDelay - gap); total = propagated + outbound WeatherDelay; keep total > 0."""
    return _cascade_pairs(*_cascade_legs(flights, p), p)


def _cascade_pairs(inb: DataFrame, outb: DataFrame, p: Params) -> DataFrame:
    j = (same_day_range_join(inb, outb, "inbound_arr_time", "outbound_dep_time",
                             p.cascade_gap_min, p.cascade_gap_max, p)
         .where(F.col("airport_a") != F.col("airport_b")))
    gap = F.col("outbound_dep_time") - F.col("inbound_arr_time")
    propagated = F.greatest(F.lit(0.0), F.col("inbound_arr_delay") - gap)
    total = propagated + F.coalesce(F.col("outbound_weather_delay"), F.lit(0.0))
    return (j.select("date", F.month("date").alias("month"),
                     pair_lo("airport_a", "airport_b").alias("pair_a"),
                     pair_hi("airport_a", "airport_b").alias("pair_b"),
                     F.col("airport_a").alias("origin"), F.col("airport_b").alias("dest"),
                     "in_flight_id", "out_flight_id", gap.alias("gap_minutes"),
                     propagated.alias("propagated_delay"), total.alias("total_cascade_minutes"))
            .where(F.col("total_cascade_minutes") > 0))


def cascade_propagation(events: DataFrame, p: Params) -> DataFrame:
    """Per canonical (pair, month): cascade events, total / mean minutes, cost."""
    return (events.groupBy(F.col("pair_a").alias("airport_a"), F.col("pair_b").alias("airport_b"), "month")
            .agg(F.count(F.lit(1)).alias("cascade_events"),
                 F.sum("total_cascade_minutes").alias("total_cascade_minutes"),
                 F.avg("total_cascade_minutes").alias("avg_cascade_minutes"))
            .withColumn("cascade_cost", F.col("total_cascade_minutes") * p.cost_per_minute))


def _odd(c: Column) -> Column:
    """Values that running sums cannot take back: NaN and infinite ones."""
    return F.isnan(c) | (F.abs(c) == float("inf"))


def cascade_totals(flights: DataFrame, p: Params) -> DataFrame:
    """``cascade_propagation`` of the flights' ``cascade_events`` without a row per pair of flights.

    An inbound leg opens its window at arrival + gap_min, closes it after arrival + gap_max, and stops
    propagating at arrival + delay. Running sums of these changes, per (date, A), tell for every minute with
    departures how many legs' windows are open (``n``), how many still propagate (``np``) and what (``late``: sum
    of arrival + delay, less the minute for each). Departures counted per (date, B, minute) are joined to
    them by (date, minute): at most airports^2 rows per minute of a day, whatever the number of flights. Legs with a
    delay that cannot be summed so (NaN, infinite, a negative weather delay) are paired as ``cascade_events`` does."""
    inb, outb = _cascade_legs(flights, p)
    weather = F.coalesce("outbound_weather_delay", F.lit(0.0))
    odd_in, odd_out = _odd(F.col("inbound_arr_delay")), _odd(weather) | (weather < 0)
    plain = replace(p, pairs_per_key=None)
    rest = _cascade_pairs(inb.where(odd_in), outb, plain).unionByName(_cascade_pairs(inb.where(~odd_in), outb.where(odd_out), plain))
    arr, until = F.col("inbound_arr_time"), F.col("inbound_arr_time") + F.col("inbound_arr_delay")
    opens, closes = arr + p.cascade_gap_min, arr + p.cascade_gap_max

    def change(at: Column, order: int, n: int, np: Column) -> Column:
        """``order`` within a minute: 0 before its departures, 2 after them."""
        return F.struct(at.cast("double").alias("minute"), F.lit(order).alias("order"), F.lit(n).cast("long").alias("n"),
                        np.cast("long").alias("np"), (np * until).cast("double").alias("late"))
    # A leg propagates to departures from the opening to before its delay's end, within the window.
    some = (until > opens).cast("int")
    inside = (until <= closes).cast("int")
    changes = (inb.where(~odd_in).dropna(subset=["airport_a"])
               .select("date", "airport_a", F.inline(F.array(change(opens, 0, 1, some), change(until, 0, 0, -some * inside),
                                                             change(closes, 2, -1, -some * (1 - inside)))))
               .groupBy("date", "airport_a", "minute", "order").agg(*[F.sum(c).alias(c) for c in ("n", "np", "late")]))
    leaving = (outb.where(~odd_out).dropna(subset=["airport_b"])
               .groupBy("date", "airport_b", F.col("outbound_dep_time").cast("double").alias("minute"))
               .agg(F.count(F.lit(1)).alias("n_out"), F.count_if(weather > 0).alias("n_wx"), F.sum(weather).alias("wx")))
    asked = (leaving.select("date", "minute").distinct().join(changes.select("date", "airport_a").distinct(), "date")
             .select("date", "airport_a", "minute", F.lit(1).alias("order"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("np"), F.lit(0.0).alias("late")))
    so_far = Window.partitionBy("date", "airport_a").orderBy("minute", "order").rowsBetween(Window.unboundedPreceding, 0)
    open_ = (changes.unionByName(asked).withColumns({c: F.sum(c).over(so_far) for c in ("n", "np", "late")})
             .where((F.col("order") == 1) & (F.col("n") > 0)))
    met = open_.join(leaving, ["date", "minute"]).where(F.col("airport_a") != F.col("airport_b"))
    # Departures with a weather delay count for every open window, others where delay propagates.
    count = F.col("n_wx") * F.col("n") + (F.col("n_out") - F.col("n_wx")) * F.col("np")
    minutes = F.col("n_out") * (F.col("late") - F.col("np") * F.col("minute")) + F.col("wx") * F.col("n")
    counted_ = met.select(pair_lo("airport_a", "airport_b").alias("pair_a"), pair_hi("airport_a", "airport_b").alias("pair_b"),
                          F.month("date").alias("month"), count.alias("events"), minutes.alias("minutes")).where(F.col("events") > 0)
    both = counted_.unionByName(rest.select("pair_a", "pair_b", "month", F.lit(1).cast("long").alias("events"), F.col("total_cascade_minutes").alias("minutes")))
    return (both.groupBy(F.col("pair_a").alias("airport_a"), F.col("pair_b").alias("airport_b"), "month")
            .agg(F.sum("events").alias("cascade_events"), F.sum("minutes").alias("total_cascade_minutes"))
            .withColumns({"avg_cascade_minutes": F.col("total_cascade_minutes") / F.col("cascade_events"),
                          "cascade_cost": F.col("total_cascade_minutes") * p.cost_per_minute}))


def cascade_airport_days(flights: DataFrame, p: Params) -> DataFrame:
    """Per day: weather-hit inbound airports x outbound airports delayed > threshold (A != B).
    The airport-day tables are pre-aggregated before the date join, so the join is
    bounded by airports^2 per day whatever the flight volume."""
    inbound = (flights.where((F.col("Dest") == p.hub) & (F.col("WeatherDelay") > 0))
               .groupBy(F.col("Origin").alias("airport_in"), F.col("FlightDate").alias("date"))
               .agg(F.sum("WeatherDelay").alias("inbound_weather_delay"),
                    F.count(F.lit(1)).alias("inbound_flights"),
                    F.avg("ArrDelay").alias("inbound_avg_delay")))
    outbound = (flights.where((F.col("Origin") == p.hub) & (F.col("DepDelay") > p.delay_threshold))
                .groupBy(F.col("Dest").alias("airport_out"), F.col("FlightDate").alias("date"))
                .agg(F.sum("DepDelay").alias("outbound_delay"),
                     F.count(F.lit(1)).alias("outbound_flights"),
                     F.avg("DepDelay").alias("outbound_avg_delay")))
    return (inbound.join(outbound, "date").where(F.col("airport_in") != F.col("airport_out"))
            .withColumns({"month": F.month("date"),
                          "pair_a": pair_lo("airport_in", "airport_out"),
                          "pair_b": pair_hi("airport_in", "airport_out"),
                          "cascade_minutes": F.col("outbound_avg_delay")}))


# ---------------------------------------------------------------------------
# Greedy one-to-one matching as a two-level prefix scan
# ---------------------------------------------------------------------------

def _prefix(df: DataFrame, part: list[str], chunk: str, order: list, sums: dict[str, str],
            maxes: dict[str, str]) -> DataFrame:
    """Inclusive running sums / maxes per ``part`` in (chunk, order) order, computed as a
    local window per (part, chunk) plus per-chunk offsets from a small per-part table,
    so no single task holds a whole ``part`` group."""
    w_local = Window.partitionBy(*part, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({**{f"_ls_{k}": F.sum(v).over(w_local) for k, v in sums.items()},
                            **{f"_lm_{k}": F.max(v).over(w_local) for k, v in maxes.items()}})
    per_chunk = df.groupBy(*part, chunk).agg(*[F.sum(v).alias(f"_cs_{k}") for k, v in sums.items()],
                                             *[F.max(v).alias(f"_cm_{k}") for k, v in maxes.items()])
    w_chunks = Window.partitionBy(*part).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(*part, chunk,
                               *[F.coalesce(F.sum(f"_cs_{k}").over(w_chunks), F.lit(0)).alias(f"_os_{k}") for k in sums],
                               *[F.max(f"_cm_{k}").over(w_chunks).alias(f"_om_{k}") for k in maxes])
    out = local.join(offsets, [*part, chunk], "inner")
    return out.withColumns({**{k: F.col(f"_os_{k}") + F.col(f"_ls_{k}") for k in sums},
                            **{k: F.greatest(F.col(f"_om_{k}"), F.col(f"_lm_{k}")) for k in maxes}}
                           ).drop(*[c for c in out.columns if c.startswith(("_ls_", "_lm_", "_os_", "_om_"))])


def greedy_assignment(flights: DataFrame, p: Params, days: DataFrame | None = None) -> DataFrame:
    """Each weather-delayed inbound (by arrival, then id) takes the earliest unused delayed
    outbound (dep > threshold) departing >= min_turnaround later; same-airport matches
    consume the outbound but are dropped afterwards.

    Closed form: with f_i = 1 + #outbound departing before arr_i + turnaround and i the
    inbound index, the matched outbound index is j_i = i + max_{k<=i}(f_k - k), unmatched
    when j_i exceeds the day's outbound count. Both the counts and the running max are
    prefix scans, run per (date, time chunk) with per-chunk offsets."""
    inb = (_inbound_legs(flights, p).where(F.col("inbound_weather_delay") > 0))
    outb = (_outbound_legs(flights, p).where(F.col("outbound_dep_delay") > p.delay_threshold))
    if days is not None:
        inb = inb.join(days.select("date").distinct(), "date", "left_semi")
        outb = outb.join(days.select("date").distinct(), "date", "left_semi")
    width = max(1, int(p.time_bin_minutes))
    ev = (inb.select("date", (F.col("inbound_arr_time") + p.min_turnaround).alias("t"), F.lit(0).alias("kind"),
                     F.col("in_flight_id").alias("id"))
          .unionByName(outb.select("date", F.col("outbound_dep_time").alias("t"), F.lit(1).alias("kind"),
                                   F.col("out_flight_id").alias("id")))
          .withColumns({"chunk": F.floor(F.col("t") / width).cast("int"),
                        "is_out": F.col("kind").cast("long"), "is_in": (1 - F.col("kind")).cast("long")}))
    order = ["t", "kind", "id"]
    counted = _prefix(ev, ["date"], "chunk", order, {"n_out": "is_out", "n_in": "is_in"}, {})
    ins = (counted.where(F.col("kind") == 0)
           .withColumn("d", F.col("n_out") + 1 - F.col("n_in")))
    ins = _prefix(ins, ["date"], "chunk", order, {}, {"dmax": "d"})
    ins = ins.select("date", F.col("id").alias("in_flight_id"), (F.col("n_in") + F.col("dmax")).alias("j"))
    outs = (counted.where(F.col("kind") == 1)
            .select("date", F.col("id").alias("out_flight_id"), F.col("n_out").alias("j")))
    matched = (ins.join(outs, ["date", "j"], "inner")
               .join(inb, ["date", "in_flight_id"]).join(outb, ["date", "out_flight_id"]))
    return (matched.where(F.col("airport_a") != F.col("airport_b"))
            .select("date", F.month("date").alias("month"), "in_flight_id", "out_flight_id",
                    F.col("airport_a").alias("origin"), F.col("airport_b").alias("dest"),
                    "inbound_arr_time", "outbound_dep_time",
                    (F.col("outbound_dep_time") - F.col("inbound_arr_time")).alias("turnaround_gap"),
                    "inbound_weather_delay", "inbound_arr_delay", "outbound_dep_delay"))


SEQUENCE_COLUMNS = ("date", "month", "year", "day_of_week", "airport_a", "airport_b", "inbound_arr_time",
                    "outbound_dep_time", "connection_minutes", "inbound_arr_delay", "outbound_dep_delay",
                    "inbound_weather_delay", "inbound_late_aircraft_delay", "outbound_weather_delay",
                    "cascading_delay", "in_flight_id", "out_flight_id")


def _day_weather(daily: DataFrame, p: Params) -> list[tuple[DataFrame, list[str]]]:
    """Day weather at A, the hub and B: lookups and their keys."""
    measures = [c for c in daily.columns if c not in ("airport", "date")]
    hub = daily.where(F.col("airport") == p.hub).select("date", *[F.col(c).alias(f"wx_hub_{c}") for c in measures])
    a, b = (daily.select(F.col("airport").alias(f"airport_{x}"), "date", *[F.col(c).alias(f"wx_{x}_{c}") for c in measures]) for x in "ab")
    return [(a, ["airport_a", "date"]), (hub, ["date"]), (b, ["airport_b", "date"])]


def _time_columns() -> dict[str, Column]:
    return {"hour_sin": cyclic_sin("inbound_arr_time", 1440.0), "hour_cos": cyclic_cos("inbound_arr_time", 1440.0),
            "dow_sin": cyclic_sin("day_of_week", 7.0), "dow_cos": cyclic_cos("day_of_week", 7.0)}


def _by_pair(pair_feats: DataFrame) -> DataFrame:
    """Pair features by canonical key (_lo, _hi, month)."""
    pf_cols = [c for c in pair_feats.columns if c not in ("airport_a", "airport_b", "month")]
    return pair_feats.select(pair_lo("airport_a", "airport_b").alias("_lo"), pair_hi("airport_a", "airport_b").alias("_hi"),
                             "month", F.col("airport_a").alias("pair_airport_a"),
                             F.col("airport_b").alias("pair_airport_b"), *pf_cols)


def _pair_keys() -> dict[str, Column]:
    return {"_lo": pair_lo("airport_a", "airport_b"), "_hi": pair_hi("airport_a", "airport_b")}


def sequences_enriched(flights: DataFrame, pair_feats: DataFrame, daily: DataFrame, p: Params,
                       finish: Callable[[DataFrame], DataFrame] = _as_is) -> DataFrame:
    """Sequences + pair features (canonical key, month) + day weather at A, B and the hub +
    cyclic time features.

    Day weather is attached to the inbound (A, hub) and outbound (B) legs before the range
    join, whose replicated side is the narrower outbound one. What pairs only copy travels as one
    struct per leg and per pair-month, unpacked once at the end: rows of over 100 columns are not written
    again by every step. Spark decides from the size of the pair-feature table whether to broadcast it.
    ``finish``: see ``sequences``."""
    wx_a, hub, wx_b = _day_weather(daily, p)
    inb, outb = _sequence_legs(flights, p, finish, _time_columns())
    for lookup, keys in (wx_a, hub):
        inb = inb.join(lookup, keys, "left")
    outb = outb.join(wx_b[0], wx_b[1], "left")
    pf = _by_pair(pair_feats)

    def packed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        return df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    legs = (packed(inb, ["date", "month", "airport_a", "inbound_arr_time", "_hit_in"], "_in"),
            packed(outb, ["date", "airport_b", "outbound_dep_time", "_hit_out"], "_out"))
    j = _sequence_pairs(*legs, flights, p, "out").withColumns(_pair_keys()).join(
        packed(pf, ["_lo", "_hi", "month"], "_pair"), ["_lo", "_hi", "month"], "left").withColumns(_pair_columns())
    of = {c: F.col(c) for c in j.columns}
    for name, df in (("_in", inb), ("_out", outb), ("_pair", pf)):
        of |= {c: F.col(f"{name}.{c}").alias(c) for c in df.columns if c not in of}
    extra = [c for lookup, keys in (wx_a, hub, wx_b) for c in lookup.columns if c not in keys]
    return j.select(*[of[c] for c in ("month", *[c for c in SEQUENCE_COLUMNS if c != "month"], *extra, *pf.columns[3:], *_time_columns())])


def enriched_rows(seqs: DataFrame, pair_feats: DataFrame, daily: DataFrame, p: Params) -> DataFrame:
    """``sequences_enriched`` of some rows of ``sequences``, chosen before any wide column is joined."""
    for lookup, keys in _day_weather(daily, p):
        seqs = seqs.join(lookup, keys, "left")
    return (seqs.withColumns(_pair_keys()).join(_by_pair(pair_feats), ["_lo", "_hi", "month"], "left")
            .withColumns(_time_columns()).drop("_lo", "_hi"))
