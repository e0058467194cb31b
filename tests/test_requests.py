"""Forecasts on request against the same sum written out."""

import datetime as dt
import math

from pyspark.sql import functions as F

from fieldcast import params as P
from fieldcast.operators import requests

TERMS = {"intercept": -1.0, "log_dur": 0.5, "log_dist": 0.25, "n_observers": 0.1, "traveling": 0.2,
         "wind_max": -0.01, "temp_mean": 0.02, "precip_sum": -0.1, "cloud_mean": 0.001,
         "hour_08": 0.3, "hour_09": 0.1, "support_08": 90.0, "support_09": 90.0, "support_10": 10.0,
         "week_00": 0.4, "site_H1": 0.7, "site_PERSONAL": -0.2}
PLACE = (40.40, -80.00)


def coefs(spark):
    rows = [("a", t, v) for t, v in TERMS.items()]
    rows += [("b", t, v) for t, v in TERMS.items() if t != "week_00"] + [("b", "week_50", 0.0),
                                                                      ("b", "week_03", 0.0)]
    return spark.createDataFrame(rows, "species_code string, term string, value double")


def forecast(spark):
    rows = [("X", dt.datetime(2024, 1, 2, h), float(h), 0.5, 10.0 + h, 40.0) for h in range(8, 11)]
    return spark.createDataFrame(rows, "area string, ts timestamp_ntz, wind double, precip double, "
                                       "temp double, cloud double")


def asked(spark, *rows):
    return spark.createDataFrame(rows, "request_id string, species_code string, lat double, lon double, "
                                 "loc_id string, area string, duration_hrs double, distance_km double, "
                                 "n_observers int, traveling boolean")


def request(i="r", species="a", place=PLACE, loc=None, area="X", dur=1.5, km=2.0, n=2, moving=True):
    return (i, species, *place, loc, area, dur, km, n, moving)


def grid(spark, *rows):
    sites = spark.createDataFrame([("H1", *PLACE)], "loc_id string, latitude double, longitude double")
    return requests.forecast_requests(asked(spark, *rows), coefs(spark), forecast(spark), sites, ["area"])


def expected(hour, dur, km, n, moving, site):
    hours = [h for h in range(hour, hour + math.ceil(dur)) if 8 <= h <= 10]
    x = (TERMS["intercept"] + TERMS[f"hour_{hour:02d}"] + TERMS["week_00"] + site
         + TERMS["log_dur"] * math.log(dur) + TERMS["log_dist"] * math.log1p(km)
         + TERMS["n_observers"] * n + TERMS["traveling"] * moving + TERMS["wind_max"] * max(hours)
         + TERMS["temp_mean"] * (10 + sum(hours) / len(hours))
         + TERMS["precip_sum"] * 0.5 * len(hours) + TERMS["cloud_mean"] * 40)
    return 1 / (1 + math.exp(-x))


def test_each_request_by_its_own_plan_and_site(spark):
    away = (PLACE[0] + 0.05, PLACE[1])
    got = {(r["request_id"], r["hour"]): r for r in grid(
        spark, request("near"), request("away", place=away, dur=0.5, km=0.0, n=1, moving=False),
        request("named", place=away, loc="H1", dur=3.0)).collect()}
    assert len(got) == 3 * len(P.FORECAST_HOURS)
    for i, plan, site in [("near", (1.5, 2.0, 2, 1), 0.7), ("away", (0.5, 0.0, 1, 0), -0.2),
                          ("named", (3.0, 2.0, 2, 1), 0.7)]:
        for h in (8, 9):
            assert math.isclose(got[i, h]["probability"], expected(h, *plan, site), rel_tol=1e-12)
        assert got[i, 10]["reason"] == "hour" and got[i, 12]["reason"] == "forecast"
        assert got[i, 10]["probability"] is None
        assert got[i, 8]["has_site_effect"] == (site == 0.7)


def test_refused_requests_keep_one_row(spark):
    rows = grid(spark, request("far", place=(10.0, 10.0)), request("nowhere", place=(None, None)),
                request("plan", dur=None), request("zero", dur=0.0), request("days", dur=1e6),
                request("alone", n=None), request("bird", species="zz"), request("none", species=None),
                request("dry", area="Y"), request("bare", area=None)).collect()
    assert {r["request_id"]: (r["reason"], r["day"], r["probability"]) for r in rows} == {
        k: (v, None, None) for k, v in {
            "far": "area", "nowhere": "area", "plan": "outing", "zero": "outing", "days": "outing",
            "alone": "outing", "bird": "species", "none": "species", "dry": "forecast",
            "bare": "forecast"}.items()}
    assert len(rows) == 10


def test_summary_and_drivers(spark):
    g = grid(spark, request("good"), request("week", species="b"), request("far", place=(10.0, 10.0)))
    got = {r["request_id"]: r for r in requests.request_summary(g, coefs(spark)).collect()}
    good = got["good"]
    live = {h: expected(h, 1.5, 2.0, 2, 1, 0.7) for h in (8, 9)}
    at = max(live, key=live.get)
    assert (good["hour"], good["until_hour"], good["n_scored"]) == (at, at + 1, 2)
    assert math.isclose(good["probability"], live[at]) and good["nearest_weeks"] is None
    # the year wraps: week 50 is three weeks before week 0, as week 3 is after
    assert got["week"]["nearest_weeks"] == [3, 50] and got["week"]["n_scored"] == 0
    assert got["far"]["n_slots"] == 0 and got["far"]["hour"] is None
    d = {r["label"]: r["points"] for r in requests.request_drivers(g, coefs(spark)).collect()}
    assert d["total"] == math.floor(live[at] * 100 + 0.5) and len(d) == 4
    assert requests.request_drivers(g.where(F.lit(False)), coefs(spark)).collect() == []


def test_no_request_gives_no_row(spark):
    assert grid(spark).collect() == []
