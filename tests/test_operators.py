"""Operators on hand-sized frames."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from fieldcast import params as P
from fieldcast.operators import (answers, best, coefficients, labels, outings, photos, rolling, scoring,
                                 spatial, stores, weather)
from fieldcast.operators.dedup import keep_first, new_rows, salted_join
from fieldcast.session import scratch_path
from fieldcast.sources import documents, tables

D = dt.date


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def outing(sub="a", time="08:00", dur=1.0, obs=1, protocol="P22", full=True, loc="L"):
    return (sub, loc, D(2024, 1, 1), time, dur, None, obs, protocol, full)


SCHEMA = ("sub_id string, loc_id string, obs_date date, obs_time string, duration_hrs double, "
          "distance_km double, n_observers int, protocol_id string, all_reported boolean")


def test_eligibility(spark):
    made = [outing("ok"), outing("short", dur=0.05), outing("long", dur=5.1), outing("edge", dur=5.0),
            outing("many", obs=11), outing("unknown", obs=None), outing("late", time=None),
            outing("other", protocol="P20"), outing("part", full=False), outing("lost", loc="X")]
    sites = spark.createDataFrame([("L", 40.4, -80.0, True), ("L", 40.4, -80.0, True)],
                                  tables.LOCATIONS)
    got = outings.eligible_outings(spark.createDataFrame(made, SCHEMA), sites)
    assert sorted(r["sub_id"] for r in got.collect()) == ["edge", "ok"]


def test_eligibility_rules_reach_the_scan(spark):
    path = scratch_path(spark, "lists")
    spark.createDataFrame([outing()], SCHEMA).write.parquet(path)
    sites = spark.createDataFrame([("L", 40.4, -80.0, True)], tables.LOCATIONS)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = outings.eligible_outings(spark.read.parquet(path), sites)
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = next(x for x in plan.splitlines() if "all_reported" in x and "PushedFilters" in x)
    pushed = pushed[pushed.index("PushedFilters"):]
    for part in ("EqualTo(all_reported,true)", "In(protocol_id", "GreaterThanOrEqual(duration_hrs",
                 "IsNotNull(obs_time)"):
        assert part in pushed
    assert df.count() == 1


def hourly(spark, hours, day=D(2024, 1, 1)):
    base = dt.datetime.combine(day, dt.time())
    return spark.createDataFrame(
        [(40.5, -80.0, base + dt.timedelta(hours=h), float(h), 1.0, float(h), 2.0, 3.0)
         for h in hours],
        "clat double, clon double, ts timestamp_ntz, wind double, precip double, temp double, "
        "cloud double, humid double")


def spanned(spark, made):
    df = spark.createDataFrame(made, SCHEMA).withColumn("clat", F.lit(40.5)).withColumn(
        "clon", F.lit(-80.0))
    return outings.with_span(df)


def test_span_join_crosses_midnight_and_counts_both_ends(spark):
    made = [outing("one"), outing("night", "23:30"), outing("dry", "15:00")]
    got = weather.with_weather(spanned(spark, made), hourly(spark, [8, 9, 10, 23, 24, 25]))
    got = {r["sub_id"]: r for r in got.collect()}
    assert (got["one"]["n_wx_hours"], got["one"]["wind_max"], got["one"]["temp_mean"]) == (2, 9, 8.5)
    assert (got["night"]["n_wx_hours"], got["night"]["wind_max"]) == (3, 25)
    # nothing matched: the total is 0, the rest unknown, and the gate says so
    dry = got["dry"]
    assert (dry["precip_sum"], dry["wind_max"], dry["n_wx_hours"]) == (0.0, None, 0)


def test_gate_counts_and_fails(spark):
    got = weather.with_weather(spanned(spark, [outing("one"), outing("dry", "15:00")]),
                               hourly(spark, [8, 9]))
    assert rows(weather.weather_gate(got)) == [(D(2024, 1, 1), 1)]
    with pytest.raises(Exception, match="no weather for outing dry"):
        weather.require_weather(got).collect()
    assert weather.require_weather(got.where("sub_id = 'one'")).count() == 1


def test_gap_needs_the_next_day(spark):
    need = spark.createDataFrame([(40.5, -80.0, D(2024, 1, 1))] * 3,
                                 "clat double, clon double, obs_date date")
    gap = weather.weather_gap(need, hourly(spark, [3]))
    assert rows(gap) == [(40.5, -80.0, D(2024, 1, 2))]


def test_new_weather_wins(spark):
    old, new = hourly(spark, [1, 2]), hourly(spark, [2, 3]).withColumn("wind", F.lit(-1.0))
    got = weather.weather_dedup(old, new.select(*reversed(new.columns)))
    assert sorted((r["ts"].hour, r["wind"]) for r in got.collect()) == [(1, 1.0), (2, -1.0), (3, -1.0)]


def test_serving_span_stays_in_the_day(spark):
    got = scoring.forecast_span(hourly(spark, [22, 23, 24, 25]), ["clat", "clon"], 2.5,
                                hours=(6, 21, 22, 23))
    day = {r["hour"]: (r["n_hours"], r["wind_max"], r["precip_sum"])
           for r in got.where("day = '2024-01-01'").collect()}
    assert day == {6: (0, None, None), 21: (2, 23.0, 2.0), 22: (2, 23.0, 2.0), 23: (1, 23.0, 1.0)}


def test_forecast_takes_first_days(spark):
    got = scoring.forecast_span(hourly(spark, range(0, 24 * 9, 6)), ["clat", "clon"], 1.0)
    days = sorted({r["day"] for r in got.collect()})
    assert days == [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(7)]


def test_parse_document(spark):
    doc = {"subId": "s", "obsDt": "2024-05-01 06:30", "durationHrs": 1.5,
           "obs": [{"speciesCode": "a", "howManyAtleast": 0, "howManyAtmost": 5},
                   {"speciesCode": "b", "howManyAtleast": 3, "howManyAtmost": 9},
                   {"speciesCode": "c", "howManyAtleast": 0}, {"speciesCode": ""}, {}]}
    bare = {"subId": "t", "obsDt": "2024-05-02"}
    none = {"subId": "u"}
    raw = spark.createDataFrame([(json.dumps(d),) for d in (doc, bare, none)], "json string")
    docs = documents.parse(raw, "json", documents.CHECKLIST_DOC)
    got = {r["sub_id"]: r for r in documents.checklist_rows(docs, "R").collect()}
    assert (got["s"]["obs_date"], got["s"]["obs_time"], got["s"]["richness"]) == (
        D(2024, 5, 1), "06:30", 5)
    assert (got["t"]["obs_date"], got["t"]["obs_time"], got["t"]["richness"]) == (
        D(2024, 5, 2), None, 0)
    assert (got["u"]["obs_date"], got["u"]["obs_dt"]) == (None, "")
    assert rows(documents.observation_rows(docs), "species_code") == [
        ("s", "a", 5), ("s", "b", 3), ("s", "c", None)]


def test_feed_first_seen(spark):
    def item(i, lat, hot=None):
        return {"subId": "x", "loc": {"locId": i, "latitude": lat, "longitude": 1.0,
                                      **({} if hot is None else {"isHotspot": hot})}}
    raw = [(2, json.dumps([item("A", 9.0, True), item("B", 2.0, True)])),
           (1, json.dumps([item("A", 1.0), item("A", 5.0, True), {"subId": "n"}]))]
    docs = documents.parse(spark.createDataFrame(raw, "day int, json string"), "json",
                           documents.FEED_DOC)
    assert rows(documents.feed_locations(docs), "loc_id") == [
        ("A", 1.0, 1.0, False), ("B", 2.0, 1.0, True)]


def test_unzip_with_absent_variable(spark):
    raw = [(1, json.dumps({"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"],
                                      "wind_speed_10m": [1.0, None]}}))]
    docs = documents.parse(spark.createDataFrame(raw, "cell int, json string"), "json",
                           documents.HOURLY_DOC)
    got = documents.weather_unzip(docs, ["cell"]).select("cell", "ts", "wind", "temp")
    assert rows(got, "ts") == [(1, dt.datetime(2024, 1, 1, 0), 1.0, None),
                               (1, dt.datetime(2024, 1, 1, 1), None, None)]
    daily = [(1, json.dumps({"daily": {"time": ["2024-01-01"], "wind_speed_10m_max": [7.0]}}))]
    docs = documents.parse(spark.createDataFrame(daily, "cell int, json string"), "json",
                           documents.DAILY_DOC)
    assert rows(documents.weather_unzip(docs, ["cell"], "daily")) == [
        (1, D(2024, 1, 1), 7.0, None, None)]


def test_append_twice_is_append_once(spark):
    path = scratch_path(spark, "t")
    a = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "k string, v int")
    for batch in (a, a, spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")):
        tables.append_new(batch, path, ["k"])
    assert rows(tables.read_table(spark, path, a.schema), "k") == [("a", 1), ("b", 2), ("c", 3)]


def test_merge_by_name_and_key(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    b = spark.createDataFrame([(9, "b"), (3, "c")], "v int, k string")
    assert rows(stores.merge_by_key(a, b, ["k"]), "k") == [("a", 1), ("b", 2), ("c", 3)]
    keys = lambda x, y: {r["k"] for r in stores.merge_by_key(x, y, ["k"]).collect()}
    assert keys(a, b) == keys(b, a)
    with pytest.raises(stores.ColumnMismatch, match=r"only local \['v'\], only incoming \['w'\]"):
        stores.merge_by_key(a, b.withColumnRenamed("v", "w"), ["k"])


def test_whole_stores_merge_by_their_own_keys(spark):
    obs = "sub_id string, species_code string, how_many int"
    local = {"observations": spark.createDataFrame([("s1", "a", 1), ("s1", "b", 2)], obs),
             "locations": spark.createDataFrame([("L", 1.0, 2.0, True)], tables.LOCATIONS)}
    other = {"observations": spark.createDataFrame([("s1", "b", 9), ("s1", "c", 3), ("s2", "a", 4)], obs)}
    other["observations"] = other["observations"].select("how_many", "species_code", "sub_id")
    merged = stores.merge_stores(local, other)
    assert rows(merged["observations"], "sub_id", "species_code") == [
        ("s1", "a", 1), ("s1", "b", 2), ("s1", "c", 3), ("s2", "a", 4)]
    assert rows(merged["locations"]) == [("L", 1.0, 2.0, True)]
    assert rows(stores.merge_stores_report(local, other)) == [("observations", 3, 2, 1)]


def test_sites_are_inserted_once(spark):
    path = scratch_path(spark, "sites")
    found = spark.createDataFrame([("A", 1.0, 1.0, True), ("B", 2.0, 2.0, False)], tables.LOCATIONS)
    assert rows(stores.insert_sites(found.where("loc_id = 'A'"), path)) == [("locations", 1, 1, 0)]
    assert rows(stores.insert_sites(found, path)) == [("locations", 2, 1, 1)]
    assert rows(stores.insert_sites(found, path)) == [("locations", 2, 0, 2)]
    assert rows(tables.read_table(spark, path, tables.LOCATIONS), "loc_id") == rows(found, "loc_id")


def test_hot_key_keeps_one_row_per_task_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, i) for i in range(1000)], "k int, id long")
    got = keep_first(df, ["k"], [F.col("id").desc()])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert rows(got) == [(1, 999)]


def test_salted_join_equals_join(spark):
    fact = spark.range(500).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id"))
                                   .alias("k"), "id")
    dim = spark.range(0, 500, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        for hot in (F.col("k") == 0, F.col("k") == 3, F.col("k").isNull()):
            for salts in (1, 4, None):
                assert rows(salted_join(fact, dim, ["k"], how, F.col("id"), hot, salts), "id") == rows(
                    fact.join(dim, "k", how), "id")


def test_new_rows_ignores_repeats(spark):
    old = spark.createDataFrame([(1,)], "k int")
    assert rows(new_rows(old, spark.createDataFrame([(1,), (2,), (2,)], "k int"), ["k"])) == [(2,)]


def test_new_rows_sort_nothing_behind_their_join(spark):
    kind = "k string, j int, v int"
    old = spark.createDataFrame([("a", 1, 1), (None, 1, 2)], kind)
    more = spark.createDataFrame([("a", 1, 9), ("a", 2, 3), ("a", 2, 3), ("b", None, 4), ("b", None, 5),
                                  (None, 1, 6), (None, None, 7)], kind)
    with_hints = new_rows(old.hint("merge"), more, ["k", "j"])
    plan = with_hints._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Window" not in plan and plan.count(" Sort [") == 2
    got = sorted(map(tuple, with_hints.collect()), key=str)
    assert [r[:2] for r in got] == sorted([("a", 2), ("b", None), (None, 1), (None, None)], key=str)
    assert all(r in [tuple(x) for x in more.collect()] for r in got) and with_hints.columns == ["k", "j", "v"]


def test_merged_stores_do_not_aggregate_again(spark, sf):
    from fieldcast.plans import bindings, catalog

    for store in catalog._two_stores(bindings.Domain(spark, sf)):
        plan = store["observations"]._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan


def test_labels_are_verified_zeros(spark):
    t = spark.createDataFrame([("a", ["x"]), ("b", [])], "sub_id string, seen array<string>")
    sp = spark.createDataFrame([("x",), ("y",)], "species_code string")
    got = labels.presence_absence(t, sp)
    assert rows(got, "sub_id", "species_code") == [
        ("a", "x", 1), ("a", "y", 0), ("b", "x", 0), ("b", "y", 0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert labels.wide_labels(t, ["x", "y"]).columns == ["sub_id", "y_x", "y_y"]


def test_hour_24_needs_support(spark):
    t = spark.createDataFrame([(24,)] * 3 + [(8,)] * 5, "hr int")
    s = labels.hour_support(t, 4)
    assert rows(s, "hr") == [(8, 5, True), (24, 3, False)]
    assert labels.supported_only(t, s).count() == 5


def test_extreme_days(spark):
    days = [(D(2025, 1, 1), 5.0), (D(2025, 1, 2), 9.0), (D(2025, 1, 3), 9.0), (D(2025, 2, 1), 4.0),
            (D(2025, 2, 2), 1.0), (D(2025, 3, 1), None), (D(2025, 11, 1), 3.0)]
    df = spark.createDataFrame([(d, w, 0.0, 1.0) for d, w in days],
                               "date date, wind_max double, precip double, temp_mean double")
    assert stores.extreme_days(df).count() == 3
    got = stores.extreme_days(df, last="2025-10-31")
    assert [(r["date"], r["kind"]) for r in got.orderBy("month").collect()] == [
        (D(2025, 1, 2), "windy"), (D(2025, 2, 2), "calm")]


def test_calendar_and_backfill(spark):
    have = spark.createDataFrame([(D(2024, 1, 3),)] * 2, "obs_date date")
    gap = stores.calendar_gap(have, "2024-01-01", "2024-02-20", as_of="2024-02-10")
    days = sorted(r["obs_date"] for r in gap.collect())
    assert days[0] == D(2024, 1, 1) and days[-1] == D(2024, 2, 3) and len(days) == 33
    plan = stores.backfill_plan(gap, max_days=20).orderBy("chunk").collect()
    assert [(p["n_days"], p["n_calls"]) for p in plan] == [(15, 15 * 111), (5, 5 * 111)]
    assert plan[0]["weeks"] == [0, 1, 2]
    assert stores.calendar_gap(have, "2024-01-05", "2024-01-01").count() == 0
    assert [str(r["date"]) for r in stores.settled_days(spark, "2024-01-20").collect()] == [
        f"2024-01-{d:02d}" for d in range(7, 14)]


def test_empty_store_fails_loudly(spark):
    c = spark.createDataFrame([], "sub_id string, loc_id string")
    o = spark.createDataFrame([], "sub_id string, species_code string")
    with pytest.raises(Exception, match="stored zero checklists"):
        stores.require_rows(stores.table_census(c, o)).collect()


# -- scoring --------------------------------------------------------------------
TERMS = {"intercept": -0.4, "log_dur": 0.75, "wind_max": -0.02, "temp_mean": 0.01,
         "hour_08": 0.5, "hour_09": 0.2, "hour_10": 0.0, "support_08": 80, "support_09": 10,
         "support_10": 60, "week_00": 0.3, "site_H1": 0.7, "site_PERSONAL": -0.1}


def coefs(spark, **more):
    return spark.createDataFrame([("sp", k, float(v)) for k, v in {**TERMS, **more}.items()],
                                 "species_code string, term string, value double")


def spans(spark, day=D(2024, 1, 2), hours=(8, 9, 10, 11), n=1):
    return spark.createDataFrame([(1, day, h, 10.0, 20.0, 0.0, 50.0, n) for h in hours],
                                 "area int, day date, hour int, wind_max double, temp_mean double, "
                                 "precip_sum double, cloud_mean double, n_hours bigint")


def sites(spark):
    return spark.createDataFrame([("H1", 1), ("H2", 1)], "loc_id string, area int")


def hand(hour, site, dur=2.0, wind=10.0):
    z = -0.4 + 0.75 * math.log(dur) + hour + 0.3 + site - 0.02 * wind + 0.01 * 20
    return 1 / (1 + math.exp(-z))


def test_score_grid(spark):
    g = scoring.score_grid(coefs(spark), spans(spark), sites(spark), ["area"],
                           scoring.Outing(duration_hrs=2.0))
    got = {(r["loc_id"], r["hour"]): r for r in g.collect()}
    assert got["H1", 8]["probability"] == pytest.approx(hand(0.5, 0.7), abs=1e-12)
    # an unknown site uses the pooled effect and says so
    assert got["H2", 8]["probability"] == pytest.approx(hand(0.5, -0.1), abs=1e-12)
    assert (got["H1", 8]["has_site_effect"], got["H2", 8]["has_site_effect"]) == (True, False)
    assert (got["H1", 9]["probability"], got["H1", 9]["reason"]) == (None, "hour")
    assert got["H1", 11]["reason"] == "hour"


def test_shortlist_equals_that_of_the_grid(spark):
    both = coefs(spark).unionByName(coefs(spark, intercept=0.2, site_H1=-2.0).withColumn(
        "species_code", F.lit("sq")))
    got = scoring.species_shortlist(both, spans(spark), sites(spark), ["area"], k=1)
    want = scoring.shortlist_of_grid(
        scoring.score_grid(both, spans(spark), sites(spark), ["area"]), k=1)
    got, want = ({(r["loc_id"], r["hour"], r["rank"]): (r["species_code"], r["probability"])
                  for r in x.collect()} for x in (got, want))
    assert got == want and got["H1", 8, 1][0] == "sp" and got["H2", 8, 1][0] == "sq"


def test_best_equals_that_of_the_grid(spark):
    both = coefs(spark).unionByName(coefs(spark, intercept=0.2, site_H1=-2.0).withColumn(
        "species_code", F.lit("sq")))
    more = spans(spark).unionByName(spans(spark, D(2024, 1, 3)))
    asked = (both, more, sites(spark), ["area"])
    g = scoring.score_grid(*asked)

    def rows(df, columns):
        return sorted(tuple(r) for r in df.select(*columns).collect())

    cols = ["species_code", "loc_id", "day", "hour", "probability", "site_effect", "wind_max"]
    carry = ["site_effect", "wind_max"]
    got = rows(best.best_window(*asked, carry=carry), cols)
    # equal slots on both days: the earlier wins
    assert got == rows(scoring.best_window(g, carry=carry), cols) and len(got) == 4
    cols = ["species_code", "day", "hour", "rank", "loc_id", "probability", "lo", "hi", "n_scored", "t"]
    for k in (1, 12):
        got = rows(best.best_hotspots(*asked, k=k), cols)
        assert got and got == rows(scoring.best_hotspots(g, k=k), cols)


def test_site_without_forecast_keeps_a_reason(spark):
    far = spark.createDataFrame([("H9", 2)], "loc_id string, area int")
    r = scoring.score_grid(coefs(spark), spans(spark), far, ["area"]).collect()
    assert [(x["loc_id"], x["day"], x["probability"], x["reason"]) for x in r] == [
        ("H9", None, None, "forecast")]
    b = best.best_probability(coefs(spark), spans(spark), far, ["area"]).first()
    assert (b["loc_id"], b["best_probability"], b["has_site_effect"]) == ("H9", None, False)
    dry = spans(spark).withColumn("cloud_mean", F.lit(None).cast("double"))
    g = scoring.score_grid(coefs(spark), dry, sites(spark), ["area"])
    assert {x["reason"] for x in g.collect()} == {"forecast"}


def test_refusal_order(spark):
    def reasons(sp):
        g = scoring.score_grid(coefs(spark), sp, sites(spark), ["area"])
        return {r["hour"]: (r["probability"], r["reason"]) for r in g.where("loc_id = 'H1'").collect()}
    later = reasons(spans(spark, D(2024, 6, 1)))
    assert later[8] == (None, "week") and later[9] == (None, "hour")
    assert set(reasons(spans(spark, D(2024, 6, 1), n=0)).values()) == {(None, "forecast")}


def test_drivers(spark):
    o = scoring.Outing(duration_hrs=2.0)
    g = scoring.score_grid(coefs(spark), spans(spark), sites(spark), ["area"], o)
    best = scoring.best_window(g, carry=["site_effect", *scoring.WEATHER])
    got = {(r["loc_id"], r["label"]): r["points"]
           for r in scoring.drivers(coefs(spark), best, o).collect()}
    base = hand(0.0, 0.7, 0.5, 12.0)
    up = lambda x: math.floor(x * 100 + 0.5)
    assert got["H1", "time of day"] == up(hand(0.5, 0.7, 0.5, 12.0) - base)
    assert got["H1", "how long"] == up(hand(0.0, 0.7, 2.0, 12.0) - base)
    assert got["H1", "weather"] == up(hand(0.0, 0.7, 0.5, 10.0) - base)
    assert got["H1", "total"] == up(hand(0.5, 0.7))


def test_ranking_and_intensity(spark):
    g = spark.createDataFrame(
        [("sp", D(2024, 1, 1), 8, f"H{i}", p) for i, p in enumerate([0.2, 0.6, 0.4, None])],
        "species_code string, day date, hour int, loc_id string, probability double")
    got = scoring.best_hotspots(g, k=2).orderBy("rank").collect()
    assert [(r["loc_id"], r["lo"], r["hi"], r["n_scored"]) for r in got] == [
        ("H1", 0.2, 0.6, 3), ("H2", 0.2, 0.6, 3)]
    assert [r["t"] for r in got] == [1.0, pytest.approx(0.5)]
    flat = scoring.with_intensity(g.withColumn("probability", F.lit(0.3)))
    assert {r["t"] for r in flat.collect()} == {0.5}


def test_best_window_prefers_the_earlier_cell(spark):
    g = spark.createDataFrame([("sp", "H", D(2024, 1, d), h, 0.5) for d in (1, 2) for h in (7, 9)],
                              "species_code string, loc_id string, day date, hour int, "
                              "probability double")
    r = scoring.best_window(g).first()
    assert (r["day"], r["hour"], r["until_hour"]) == (D(2024, 1, 1), 7, 8)


def test_weeks(spark):
    c = spark.createDataFrame([("sp", f"week_{w:02d}", 0.0) for w in (0, 18, 50)]
                              + [("none", "intercept", 1.0)],
                              "species_code string, term string, value double")
    cover = scoring.week_coverage(c, "2024-01-03").where("species_code = 'sp'").collect()
    assert len(cover) == 53 and sum(r["fitted"] for r in cover) == 3
    assert [r["week"] for r in cover if r["is_current"]] == [0]
    near = [(r["nearest"], r["distance"]) for r in scoring.nearest_weeks(c, 2)
            .where("week = 51 and species_code = 'sp'").orderBy("rank").collect()]
    assert near == [(50, 1), (0, 2)]


# -- coefficient documents ------------------------------------------------------
def test_document_to_terms_and_back(spark):
    doc = spark.createDataFrame([("sp", 1.0, {"6": 0.5}, {"31": 0.25}, {"PERSONAL": 0.1},
                                  {"6": 77.0})],
                                "species_code string, intercept double, hour map<string,double>, "
                                "week map<string,double>, site map<string,double>, "
                                "hour_support map<string,double>")
    for c in P.NUMERIC:
        doc = doc.withColumn(c, F.lit(None).cast("double"))
    split = lambda x: F.struct(F.lit(x).alias("brier"), F.lit(None).cast("double").alias("auc"),
                               F.lit(0.5).alias("cal_mae"))
    doc = doc.withColumn("meta", F.struct(F.lit(200).alias("detections"),
                                          split(0.1).alias("by_date"),
                                          F.when(F.lit(False), split(0.2)).alias("by_site")))
    got = {r["term"]: r["value"] for r in coefficients.coef_long(doc).collect()}
    assert got == {"intercept": 1.0, "hour_06": 0.5, "week_31": 0.25, "site_PERSONAL": 0.1,
                   "support_06": 77.0, "meta_detections": 200.0, "meta_by_date_brier": 0.1,
                   "meta_by_date_cal_mae": 0.5}
    text = coefficients.coef_bundle(coefficients.coef_long(doc)).first()["document"]
    assert json.loads(text) == got and list(json.loads(text)) == sorted(got)


def test_replace_by_key_leaves_other_species(spark):
    path = scratch_path(spark, "c")
    mk = lambda *r: spark.createDataFrame(list(r), "species_code string, term string, value double")
    coefficients.write_by_species(mk(("a", "x", 1.0), ("a", "old", 1.0), ("b", "x", 2.0)), path)
    coefficients.write_by_species(mk(("a", "x", 5.0)), path)
    got = spark.read.parquet(path).select("species_code", "term", "value")
    assert rows(got, "species_code") == [("a", "x", 5.0), ("b", "x", 2.0)]


def test_refit_diff(spark):
    a = coefs(spark)
    same = coefficients.coef_diff(a, a.withColumn("value", F.col("value") + 1e-8)).first()
    assert same["same_terms"] and same["within"] and same["max_abs_diff"] == pytest.approx(1e-8)
    off = coefficients.coef_diff(a, a.where("term <> 'intercept'")).first()
    assert (off["n_only_left"], off["n_only_right"], off["within"]) == (1, 0, False)


def test_names_fall_back(spark):
    c = spark.createDataFrame([("a", "t", 0.0), ("b", "t", 0.0), ("c", "t", 0.0)],
                              "species_code string, term string, value double")
    ph = spark.createDataFrame([("a", "Zed", True)],
                               "species_code string, common_name string, has_main boolean")
    tx = spark.createDataFrame([("a", "no", ), ("b", "Bee")], "species_code string, common_name string")
    assert rows(coefficients.species_list(c, ph, tx)) == [
        ("b", "Bee", False), ("a", "Zed", True), ("c", "c", False)]


# -- places, photos ---------------------------------------------------------------
def test_nearest_sites_equals_brute_force(spark):
    rng = random.Random(5)
    # a third of all sites crowd one spot; two pairs sit across the date line and near a pole
    at = ([(40.4 + rng.random() / 1000, -80 + rng.random() / 1000) for _ in range(60)]
          + [(40 + rng.random(), -80.5 + rng.random()) for _ in range(120)]
          + [(0.0, 179.99), (0.02, -179.98), (89.95, 10.0), (89.95, -170.0)])
    pts = ([(40.4 + rng.random() / 500, -80 + rng.random() / 500) for _ in range(15)]
           + [(40 + rng.random(), -80.5 + rng.random()) for _ in range(25)]
           + [(0.01, -179.999), (89.96, 100.0), (-45.0, 3.0)])
    s = spark.createDataFrame([(f"H{i:03d}", a, b) for i, (a, b) in enumerate(at)],
                              "loc_id string, latitude double, longitude double")
    p = spark.createDataFrame([(f"p{i}", a, b) for i, (a, b) in enumerate(pts)],
                              "point_id string, lat double, lon double")

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * P.EARTH_KM * math.asin(math.sqrt(h))

    for k, radius in ((1, 0.2), (10, 25.0), (3, 5.0)):
        got = {(r["point_id"], r["rank"]): r["loc_id"]
               for r in spatial.nearest_sites(p, s, k, radius).collect()}
        want = {}
        for i, (a, b) in enumerate(pts):
            near = sorted((round(km(a, b, c, d), 9), f"H{j:03d}") for j, (c, d) in enumerate(at)
                          if km(a, b, c, d) <= radius)
            want.update({(f"p{i}", n + 1): x for n, (_, x) in enumerate(near[:k])})
        assert got == want


def test_a_lone_place_meets_the_edge_of_a_town(spark):
    rng = random.Random(8)
    town = [(f"H{i:05d}", 40.5 + rng.random() / 100, -80.0 + rng.random() / 100) for i in range(20000)]
    s = spark.createDataFrame(town, "loc_id string, latitude double, longitude double")
    lone = spark.createDataFrame([(40.45, -80.0), (40.3, -80.0)], "lat double, lon double")
    met = spatial.candidates(lone, s, 3, 25.0).groupBy("lat").count().collect()
    assert len(met) == 2 and all(3 <= r["count"] < 500 for r in met)
    # a spot that many sites share counts as k of them
    one = spark.createDataFrame([(f"S{i}", 40.0, -80.0) for i in range(500)],
                                "loc_id string, latitude double, longitude double")
    got = spatial.nearest_sites(lone.withColumn("point_id", F.col("lat").cast("string")), one, 2, 80.0)
    assert sorted(r["loc_id"] for r in got.collect()) == ["S0", "S0", "S1", "S1"]


def test_appends_read_only_touched_ranges(spark):
    path = scratch_path(spark, "ranges")
    made = lambda ids, day: spark.createDataFrame(
        [(f"S{i}", D(2024, 1, day)) for i in ids], "sub_id string, obs_date date")
    for batch in (made(range(100), 1), made(range(100, 200), 2)):
        tables.append_new(batch, path, ["sub_id"], ["obs_date"], ids=50)
    # an outing of the first day is filed again under another date, with two new ones
    again = made([7, 210, 211], 9)
    known = tables.known_keys(path, again, ["sub_id"], ids=50)
    plan = known._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "key_range" in filters and known.count() == 50
    tables.append_new(again, path, ["sub_id"], ["obs_date"], ids=50)
    got = spark.read.parquet(path)
    assert got.count() == 202 and got.where("sub_id = 'S7'").first()["obs_date"] == D(2024, 1, 1)
    # ids without a number have ranges of their own, below zero
    odd = spark.createDataFrame([("x",), ("S9",), ("S99999999999999999999999",)], "k string")
    assert [r[0] < 0 for r in odd.select(tables.key_range(F.col("k"))).collect()] == [True, False, True]


def test_answers_are_shared_until_they_expire(spark):
    seen = spark.createDataFrame(
        [("s1", "a", 40.0, -80.0, D(2024, 1, 18)), ("s2", "b", 40.02, -80.0, D(2024, 1, 22)),
         ("s3", "a", 10.0, 10.0, D(2024, 1, 22))],
        "sub_id string, species_code string, lat double, lon double, obs_date date")
    points = spark.createDataFrame([("p", 40.01, -80.01), ("q", 39.99, -80.04), ("far", -10.0, 0.0),
                                    ("none", None, 0.0)], "point_id string, lat double, lon double")
    root = scratch_path(spark, "answers")
    ask = lambda who, day: {(r["point_id"], r["species_code"]): str(r["answered_on"]) for r in
                            answers.ask_recent(points.where(who), seen, root, day).collect()}
    assert ask("point_id = 'p'", "2024-01-20") == {("p", "a"): "2024-01-20"}
    # q rounds to the same place and shares the answer, also what it does not know yet
    assert ask("true", "2024-01-23") == {("p", "a"): "2024-01-20", ("q", "a"): "2024-01-20"}
    headers = spark.read.parquet(f"{root}/headers")
    assert headers.count() == 2  # the place where nothing was seen is answered too
    late = {(p, s): "2024-01-24" for p in "pq" for s in "ab"}
    assert ask("true", "2024-01-24") == late
    assert ask("true", "2024-01-24") == late and spark.read.parquet(f"{root}/headers").count() == 3


def test_rolling_grid_equals_a_recompute(spark):
    coefs = spark.createDataFrame(
        [(s, t, v) for s in ("a", "b") for t, v in [
            ("intercept", -0.4), ("log_dur", .75), ("wind_max", -.02), ("temp_mean", .01), ("hour_08", .3),
            ("support_08", 60.0), ("support_09", 70.0), ("week_00", .1), ("site_H1", .2), ("site_PERSONAL", 0.0)]],
        "species_code string, term string, value double")
    sites = spark.createDataFrame([("H1", 1), ("H2", 1), ("H3", 2), ("H4", 3)], "loc_id string, area int")
    def snapshot(rows):
        return spark.createDataFrame([(a, D(2024, 1, d), h, w, 9.0, 0.0, None if w is None else 50.0, int(w is not None))
                                      for a, d, h, w in rows],
                                     "area int, day date, hour int, wind_max double, temp_mean double, "
                                     "precip_sum double, cloud_mean double, n_hours bigint")
    first = snapshot([(1, 1, 8, 5.0), (1, 1, 9, 6.0), (1, 2, 8, None), (1, 2, 9, 7.0), (2, 1, 8, 5.0)])
    # a day goes, one comes, an hour changes, an hour vanishes, one area loses and one gains its forecast
    second = snapshot([(1, 2, 8, None), (1, 2, 9, 8.0), (1, 3, 8, 1.0), (3, 3, 8, 2.0), (3, 3, 9, 2.0)])
    third = snapshot([(1, 2, 9, 8.0), (1, 3, 8, 1.0), (3, 3, 8, 2.0), (3, 3, 9, 3.0)])
    root, before, cost = rolling.new_store(spark), None, []
    for v, snap in enumerate((first, second, third), 1):
        took = rolling.roll(root, v, coefs, before, snap, sites, ["area"])
        cost.append({(r["area"], r["day"].day): (r["n_slots"], r["n_scored"]) for r in took.collect()})
        names = ["species_code", "loc_id", "area", "day", "hour", "reason", "probability", "has_site_effect"]
        got = rolling.current(spark, root, v, ["area"]).select(*names)
        want = rolling.recomputed(coefs, snap, sites, ["area"]).select(*names)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        before = snap
    assert cost[1] == {(1, 2): (2, 1), (1, 3): (1, 1), (3, 3): (2, 2)}
    assert cost[2] == {(1, 2): (1, 0), (1, 3): (1, 0), (3, 3): (2, 1)}


def test_photos(spark):
    schema = ("taxon_id int, photo_id int, url string, licence string, attribution string, "
              "is_curated boolean, position int, quality_grade string, votes double, month int, "
              "is_female boolean")
    def p(i, lic="cc-by", cur=False, grade="research", votes=1.0, month=1, fem=False):
        return (1, i, f"u{i}/square.jpg", lic, " a\n\t b  ", cur, i, grade, votes, month, fem)
    made = [p(1, None, True), p(2, cur=True), p(3, cur=True), p(4, cur=True), p(5, cur=True),
            p(6, votes=5.0), p(7, votes=9.0, grade="casual"), p(8, "all-rights", votes=9.0),
            p(9, votes=5.0, fem=True), p(10, month=0, votes=99.0)]
    got = {r["slot"]: (r["photo_id"], r["url"], r["attribution"]) for r in
           photos.photo_top(spark.createDataFrame(made, schema)).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        "main_1": 2, "main_2": 3, "main_3": 4, "month_01": 6, "female": 9}
    assert got["main_1"][1:] == ("u2/medium.jpg", "a b")


def test_white_space_beyond_ascii(spark):
    text = " a  b\x1cc　\n"
    df = spark.createDataFrame([(text,)], "t string").select(photos.one_line(F.col("t")))
    assert df.first()[0] == " ".join(text.split())


def test_validation_keeps_incomplete_lists(spark):
    made = [("a", "stationary", 30, None, 1), ("b", "traveling", 30, None, 1),
            ("c", "incidental", None, None, None), ("d", "driving", 0, None, 51)]
    df = spark.createDataFrame(made, "id string, protocol string, duration_min int, "
                                     "distance_km double, party_size int")
    got = {r["id"]: list(r["problems"]) for r in outings.validate_outings(df).collect()}
    assert got == {"a": [], "b": ["distance_km"], "c": [],
                   "d": ["protocol", "duration_min", "party_size"]}


def one_area(spark):
    """Terms, a day's slots and 64 sites, all in one area."""
    terms = spark.createDataFrame(
        [(s, t, v) for s in ("a", "b") for t, v in [
            ("intercept", -0.4), ("support_08", 60.0), ("support_09", 70.0), ("week_00", .1),
            *((x, 0.0) for x in P.SCALAR_TERMS[1:]), ("site_PERSONAL", 0.0)]],
        "species_code string, term string, value double")
    slots = spark.createDataFrame([(1, D(2024, 1, 1), h, 5.0, 9.0, 0.0, 50.0, 1) for h in (8, 9)],
                                  "area int, day date, hour int, wind_max double, temp_mean double, "
                                  "precip_sum double, cloud_mean double, n_hours bigint")
    return terms, slots, spark.createDataFrame([(f"H{i}", 1) for i in range(64)], "loc_id string, area int")


def test_a_day_of_an_area_is_not_one_task(spark):
    terms, slots, sites = one_area(spark)
    root = rolling.new_store(spark)
    rolling.roll(root, 1, terms, None, slots, sites, ["area"])
    rolling.roll(root, 2, terms, slots, slots.withColumn("wind_max", F.lit(6.0)), sites, ["area"])
    for v in (1, 2):
        wrote = spark.read.parquet(f"{root}/grid/version={v}")
        assert wrote.count() == 64 * 2 * 2
        assert wrote.select(F.input_file_name()).distinct().count() > 1
    assert rolling.current(spark, root, 2, ["area"]).count() == 64 * 2 * 2


def test_sites_of_an_area_are_ranked_by_several_tasks(spark):
    terms, slots, sites = one_area(spark)
    for made, n in ((scoring.species_shortlist(terms, slots, sites, ["area"]), 64 * 2 * 2),
                    (best.best_window(terms, slots, sites, ["area"]), 64 * 2)):
        assert made.count() == n
        assert made.select(F.spark_partition_id()).distinct().count() > 1
