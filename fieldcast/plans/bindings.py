"""The given tables as survey tables.

Each frame is a lazy projection or aggregate of whole given tables, so its size
follows theirs. ``SQL`` holds the same definitions for the checks.

orders -> checklists, customer and supplier -> sites, lineitem -> observations,
events -> hourly weather, part -> photos, documents -> attribution texts.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast import params as P
from fieldcast.functions import clock_hour, hour_bucket, week_of
from fieldcast.operators import labels, outings, scoring
from fieldcast.operators.evaluation import group_holdout
from fieldcast.plans.features import model_table
from fieldcast.session import stored


def _day(text: str) -> Column:
    return F.lit(text).cast("date")


def _ratio(c: Column, by: float) -> Column:
    return c.cast("double") / F.lit(by)


def _fixture(a: Column, b: Column, factor: int, by: float = 100.0) -> Column:
    """Deterministic coefficient between -1 and 1 (at ``by`` 100)."""
    return _ratio((a * 31 + b * factor) % 200 - 100, by)


class Domain:
    """Survey tables over one folder of given tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._read: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self._read[name]

    @cached_property
    def checklists(self) -> DataFrame:
        k, cust = F.col("o_orderkey"), F.col("o_custkey")
        two = lambda c: F.lpad(c.cast("string"), 2, "0")
        return self.table("orders").select(
            F.concat(F.lit("S"), k.cast("string")).alias("sub_id"),
            F.when(F.expr("(o_orderkey div 8) % 2 = 0"),
                   F.concat(F.lit("H"), F.expr("cast(o_custkey div 15 as string)")))
            .otherwise(F.concat(F.lit("L"), cust.cast("string"))).alias("loc_id"),
            F.date_add(_day("2024-01-01"), (k % 29).cast("int")).alias("obs_date"),
            F.when(k % 97 != 0, F.concat(two(F.expr("(o_orderkey div 29) % 24")), F.lit(":"),
                                         two((k % 4) * 15))).alias("obs_time"),
            (_ratio((k * 7) % 60, 10.0) + F.lit(0.05)).alias("duration_hrs"),
            F.when(k % 11 != 0, _ratio(k % 70, 10.0)).alias("distance_km"),
            (k % 13).cast("int").alias("n_observers"),
            F.concat(F.lit("P2"), (k % 4).cast("string")).alias("protocol_id"),
            (F.col("o_orderstatus") != "P").alias("all_reported"),
            F.concat(F.lit("U"), cust.cast("string")).alias("observer"),
            F.col("o_orderstatus").alias("status"))

    @cached_property
    def locations(self) -> DataFrame:
        def part(df: DataFrame, key: str, mark: str, hot: bool, a: int, b: int) -> DataFrame:
            k = F.col(key)
            return df.select(
                F.concat(F.lit(mark), k.cast("string")).alias("loc_id"),
                (F.lit(40.19) + _ratio((k * a) % 50, 100.0)).alias("lat"),
                (F.lit(-80.34) + _ratio((k * b) % 66, 100.0)).alias("lon"),
                F.lit(hot).alias("is_hotspot"))

        # sites in debt have no coordinates yet: the unresolved ones
        people = self.table("customer").where(F.col("c_acctbal") >= 0)
        public = self.table("supplier").where(F.col("s_acctbal") >= 0)
        return (part(people, "c_custkey", "L", False, 1, 1)
                .unionByName(part(public, "s_suppkey", "H", True, 7, 11)))

    @cached_property
    def observations(self) -> DataFrame:
        c = F.col("l_partkey") % 40
        two = F.lpad(c.cast("string"), 2, "0")
        code = F.when(c < 3, F.concat(F.lit("y000"), two)).otherwise(F.concat(F.lit("sp"), two))
        q = F.max("l_quantity").cast("int")
        return (self.table("lineitem")
                .select(F.concat(F.lit("S"), F.col("l_orderkey").cast("string")).alias("sub_id"),
                        code.alias("species_code"), "l_quantity")
                .groupBy("sub_id", "species_code")
                .agg((q % 4).alias("at_least"), q.alias("at_most"))
                .withColumn("how_many", F.coalesce(F.nullif("at_least", F.lit(0)), "at_most")))

    def hourly(self, events: DataFrame) -> DataFrame:
        u, v = F.col("user_id"), F.col("value")
        return (events.select(
            (F.lit(40.25) + F.lit(0.25) * (u % 3)).alias("clat"),
            (F.lit(-80.25) + F.lit(0.25) * F.expr("(user_id div 3) % 3")).alias("clon"),
            F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "value")
            .groupBy("clat", "clon", "ts")
            .agg(F.max(v % 40).alias("wind"), F.sum(v % 3).alias("precip"),
                 F.avg(v % 30).alias("temp"), F.avg(v % 100).alias("cloud"),
                 F.avg(v % 80).alias("humid")))

    @cached_property
    def weather(self) -> DataFrame:
        return self.hourly(self.table("events"))

    @cached_property
    def model(self) -> DataFrame:
        return model_table(self.checklists, self.locations, self.observations, self.weather,
                           carry=["observer"])

    # -- a deterministic set of fitted terms ---------------------------------
    @cached_property
    def species(self) -> DataFrame:
        code = F.col("species_code")
        return (self.observations.where(outings.is_species(code))
                .groupBy("species_code").agg(F.count(F.lit(1)).alias("detections"))
                .withColumn("sno", F.substring(code, 3, 9).try_cast("int")))

    @cached_property
    def coefs(self) -> DataFrame:
        """The published term table, written and read back as its users would."""
        sno = F.col("sno")
        clocked = self.checklists.select(
            hour_bucket(clock_hour(F.col("obs_time"))).alias("hr"), "obs_date")
        hours = (clocked.where(F.col("hr").isNotNull()).groupBy("hr").agg(F.count(F.lit(1)).alias("n"))
                 .select(F.collect_list(F.struct("hr", "n"))).scalar())
        weeks = clocked.select(F.collect_set(week_of(F.col("obs_date")))).scalar()
        sp = self.species.withColumn("hours", hours).withColumn("weeks", weeks)

        def row(term: Column, value: Column) -> Column:
            return F.struct(term.alias("term"), value.cast("double").alias("value"))

        scalars = F.array(*[
            row(F.lit(t), _fixture(sno, F.lit(i), 17, 1e4 if i >= 6 else 100.0))
            for i, t in enumerate(P.SCALAR_TERMS, 1)])
        hour = F.transform("hours", lambda h: row(
            F.format_string("hour_%02d", h["hr"]), _fixture(sno, h["hr"], 13)))
        support = F.transform("hours", lambda h: row(
            F.format_string("support_%02d", h["hr"]),
            F.when(h["hr"] == sno % 15 + 6, F.lit(10)).otherwise(h["n"])))
        week = F.transform(F.filter("weeks", lambda w: w != sno % 5), lambda w: row(
            F.format_string("week_%02d", w), _fixture(sno, w, 19)))
        pooled = row(F.lit("site_PERSONAL"), _ratio(sno % 10, 10.0))
        found = row(F.lit("meta_detections"), F.col("detections"))
        marks = [("meta_by_date_auc", 50, 0), ("meta_by_date_brier", 7, 0),
                 ("meta_by_date_cal_mae", 3, 0), ("meta_by_site_auc", 40, 9),
                 ("meta_by_site_brier", 9, 9), ("meta_by_site_cal_mae", 5, 9)]
        metric = F.array_compact(F.array(*[
            F.when(F.lit(m == 0) | (sno % 9 != 0), row(F.lit(t), _ratio(F.lit(a) + sno % 40, 100.0)))
            for t, a, m in marks]))
        per_species = sp.select("species_code", F.inline(F.concat(
            scalars, hour, support, week, F.array(pooled, found), metric)))
        packed = self.species.select(F.collect_list(F.struct("species_code", "sno"))).scalar()
        site = (self.locations.where("is_hotspot")
                .select("loc_id", F.substring("loc_id", 2, 20).try_cast("long").alias("hno"),
                        F.inline(packed))
                .where((F.col("hno") + sno) % 7 != 0)
                .select("species_code", F.concat(F.lit("site_"), "loc_id").alias("term"),
                        _fixture(sno, F.col("hno"), 17).alias("value")))
        out = per_species.unionByName(site)
        return stored(out, "coefs")

    @cached_property
    def models(self) -> DataFrame:
        """The same terms as nested documents, one per species."""
        t, v = F.col("term"), F.col("value")

        def block(prefix: str, number: bool = True) -> Column:
            key = F.substring(t, len(prefix) + 2, 99)
            # documents use bare numbers as keys
            key = key.try_cast("int").cast("string") if number else key
            is_in = t.startswith(prefix + "_")
            return F.map_from_entries(F.collect_list(F.when(is_in, F.struct(
                F.when(is_in, key).alias("k"), v.alias("x")))))

        one = lambda name: F.max(F.when(t == name, v))
        split = lambda s: F.struct(*[one(f"meta_{s}_{k}").alias(k)
                                     for k in ("brier", "auc", "cal_mae")]).alias(s)
        return self.coefs.groupBy("species_code").agg(
            *[one(s).alias(s) for s in P.SCALAR_TERMS],
            block("hour").alias("hour"), block("week").alias("week"),
            block("site", number=False).alias("site"), block("support").alias("hour_support"),
            F.struct(one("meta_detections").alias("detections"), split("by_date"),
                     split("by_site")).alias("meta"))

    @cached_property
    def refit(self) -> DataFrame:
        """A second fit: half the species, shifted by one, without hour terms."""
        half = F.substring("species_code", 3, 9).try_cast("int") % 2 == 0
        return (self.coefs.where(half & ~F.col("term").startswith("hour_"))
                .withColumn("value", F.col("value") + F.lit(1.0)))

    # -- scoring --------------------------------------------------------------
    @cached_property
    def hotspots(self) -> DataFrame:
        return (outings.with_cell(outings.unique_locations(self.locations).where("is_hotspot"))
                .select("loc_id", "lat", "lon", "clat", "clon"))

    @cached_property
    def site_names(self) -> DataFrame:
        # rich suppliers left the reference: the retired sites
        names = self.table("supplier").where(F.col("s_acctbal") < 9000).select(
            F.concat(F.lit("H"), F.col("s_suppkey").cast("string")).alias("loc_id"),
            F.col("s_name").alias("name"))
        return names.join(self.locations.select("loc_id", F.col("lat").alias("latitude"),
                                                F.col("lon").alias("longitude")), "loc_id")

    def spans(self, duration_hrs: float = 1.0) -> DataFrame:
        return scoring.forecast_span(self.weather, ["clat", "clon"], duration_hrs)

    @cached_property
    def grid(self) -> DataFrame:
        return scoring.score_grid(self.coefs, self.spans(), self.hotspots, ["clat", "clon"])

    # -- deterministic out-of-sample scores -----------------------------------
    @cached_property
    def scored(self) -> DataFrame:
        k = F.substring("sub_id", 2, 20).try_cast("long")
        sno = F.substring("species_code", 3, 9).try_cast("int")
        table = stored(self.model.select("sub_id", "loc_id", "obs_date", "seen"), "model")
        rows = (labels.presence_absence(table, labels.species_floor(self.observations))
                .withColumn("p", ((k * 37 + sno * 101) % 1000 + F.lit(0.5)) / F.lit(1000.0)))

        def held(group: str, name: str) -> DataFrame:
            test = group_holdout(table, group).where("is_test").select(group)
            return rows.join(test, group, "left_semi").select(
                F.lit(name).alias("split"), "species_code", "p", "y")

        return stored(held("loc_id", "by_site").unionByName(held("obs_date", "by_date")), "scored")

    # -- photos, points, logs -------------------------------------------------
    @cached_property
    def photos(self) -> DataFrame:
        k = F.col("p_partkey")
        licences = F.array(*[F.lit(x) for x in P.USABLE_LICENCES], F.lit("all-rights"),
                           F.lit(None).cast("string"))
        return self.table("part").select(
            (k % 37).alias("taxon_id"), k.alias("photo_id"),
            F.concat(F.lit("https://photos.example.org/"), k.cast("string"),
                     F.lit("/square.jpg")).alias("url"),
            F.element_at(licences, (k % 9 + 1).cast("int")).alias("licence"),
            F.concat(F.lit(" (c)  "), "p_name", F.lit("\n\t"), "p_brand").alias("attribution"),
            (F.col("p_size") % 13 == 0).alias("is_curated"), k.alias("position"),
            F.when(F.col("p_type") == "SMALL", "casual").otherwise("research")
            .alias("quality_grade"),
            F.col("p_retailprice").alias("votes"), (F.col("p_size") % 13).alias("month"),
            (F.col("p_size") % 2 == 1).alias("is_female"))

    @cached_property
    def sightings(self) -> DataFrame:
        """Recorded species with place and date."""
        return (self.observations.where(outings.is_species(F.col("species_code")))
                .select("sub_id", "species_code")
                .join(self.checklists.select("sub_id", "loc_id", "obs_date"), "sub_id")
                .join(self.locations.select("loc_id", "lat", "lon"), "loc_id"))

    @cached_property
    def pins(self) -> DataFrame:
        """Points users dropped on the map, some metres off a site."""
        k = F.col("c_custkey")
        return self.table("customer").select(
            F.col("c_name").alias("point_id"),
            F.concat(F.lit("sp"), F.lpad((k % 37 + 3).cast("string"), 2, "0")).alias("species_code"),
            (F.lit(40.19) + _ratio(k % 50, 100.0) + _ratio(k % 7, 1e4)).alias("lat"),
            (F.lit(-80.34) + _ratio((k * 3) % 66, 100.0) + _ratio(k % 11, 1e4)).alias("lon"))

    @cached_property
    def requests(self) -> DataFrame:
        """Forecasts users ask for at their pins; a quarter name a site."""
        k = F.col("c_custkey")
        asked = self.table("customer").select(
            F.col("c_name").alias("request_id"),
            F.concat(F.lit("sp"), F.lpad((k % 39 + 2).cast("string"), 2, "0")).alias("species_code"),
            F.when(k % 4 == 0, F.concat(F.lit("H"), F.expr("cast(c_custkey div 15 as string)")))
            .alias("loc_id"),
            F.when(k % 31 != 0, _ratio(k % 6 + 1, 2.0)).alias("duration_hrs"),
            _ratio(k % 5, 2.0).alias("distance_km"), (k % 4 + 1).cast("int").alias("n_observers"),
            (k % 2 == 1).alias("traveling"))
        pins = self.pins.select(F.col("point_id").alias("request_id"), "lat", "lon")
        return outings.with_cell(asked.join(pins, "request_id"))

    @cached_property
    def logged(self) -> DataFrame:
        """User-logged outings, valid or not."""
        k = F.col("o_orderkey")
        return self.table("orders").select(
            F.concat(F.lit("A"), k.cast("string")).alias("outing_id"),
            F.when(F.col("o_orderpriority") == "5-LOW", "driving")
            .when(F.col("o_orderstatus") == "O", "stationary")
            .when(F.col("o_orderstatus") == "F", "traveling").otherwise("incidental")
            .alias("protocol"),
            F.when(k % 10 != 0, (k % 800).cast("int")).alias("duration_min"),
            F.when(k % 7 != 0, _ratio(k % 50 - 2, 4.0)).cast("decimal(6,2)").alias("distance_km"),
            F.when(k % 12 != 0, (k % 55).cast("int")).alias("party_size"))


def spline_sql(x: str, knots: list[str]) -> list[str]:
    """SQL of the cubic basis of ``x`` on named knots, without the first function."""
    last = max(i for i in range(len(knots) - 1) if knots[i] != knots[i + 1])
    level = ["0" if a == b else f"CASE WHEN {x} >= {a} AND {x} {'<=' if i == last else '<'} {b} THEN 1.0::DOUBLE ELSE 0 END"
             for i, (a, b) in enumerate(zip(knots, knots[1:]))]
    for d in range(1, 4):
        level = [" + ".join(
            ([f"({x} - {knots[i]}) / ({knots[i + d]} - {knots[i]}) * ({level[i]})"] if knots[i] != knots[i + d] else [])
            + ([f"({knots[i + d + 1]} - {x}) / ({knots[i + d + 1]} - {knots[i + 1]}) * ({level[i + 1]})"]
               if knots[i + 1] != knots[i + d + 1] else [])) or "0" for i in range(len(level) - 1)]
    return level[1:]


# The same definitions for the checks. Names in a body pull in what they need.
SQL = {
    "checklists": """
 SELECT 'S'||o_orderkey AS sub_id, o_orderkey AS okey,
  CASE WHEN (o_orderkey // 8) % 2 = 0 THEN 'H'||(o_custkey // 15) ELSE 'L'||o_custkey END AS loc_id,
  DATE '2024-01-01' + CAST(o_orderkey % 29 AS INTEGER) AS obs_date,
  CASE WHEN o_orderkey % 97 <> 0 THEN lpad(CAST((o_orderkey // 29) % 24 AS VARCHAR), 2, '0')||':'
   ||lpad(CAST((o_orderkey % 4) * 15 AS VARCHAR), 2, '0') END AS obs_time,
  CAST((o_orderkey * 7) % 60 AS DOUBLE) / 10.0::DOUBLE + 0.05::DOUBLE AS duration_hrs,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 70 AS DOUBLE) / 10.0::DOUBLE END AS distance_km,
  CAST(o_orderkey % 13 AS INTEGER) AS n_observers, 'P2'||(o_orderkey % 4) AS protocol_id,
  o_orderstatus <> 'P' AS all_reported, 'U'||o_custkey AS observer, o_custkey AS cust,
  o_orderstatus AS status FROM orders""",
    "locations": """
 SELECT 'L'||c_custkey AS loc_id, 40.19::DOUBLE + CAST(c_custkey % 50 AS DOUBLE) / 100.0::DOUBLE AS lat,
  -80.34::DOUBLE + CAST(c_custkey % 66 AS DOUBLE) / 100.0::DOUBLE AS lon, false AS is_hotspot
 FROM customer WHERE c_acctbal >= 0
 UNION ALL
 SELECT 'H'||s_suppkey, 40.19::DOUBLE + CAST((s_suppkey * 7) % 50 AS DOUBLE) / 100.0::DOUBLE,
  -80.34::DOUBLE + CAST((s_suppkey * 11) % 66 AS DOUBLE) / 100.0::DOUBLE, true
 FROM supplier WHERE s_acctbal >= 0""",
    "observations": """
 SELECT sub_id, species_code, q % 4 AS at_least, q AS at_most,
  coalesce(nullif(q % 4, 0), q) AS how_many
 FROM (SELECT 'S'||l_orderkey AS sub_id, CASE WHEN l_partkey % 40 < 3
   THEN 'y000'||lpad(CAST(l_partkey % 40 AS VARCHAR), 2, '0')
   ELSE 'sp'||lpad(CAST(l_partkey % 40 AS VARCHAR), 2, '0') END AS species_code,
   CAST(trunc(max(l_quantity)) AS INTEGER) AS q FROM lineitem GROUP BY 1, 2)""",
    "weather": """
 SELECT 40.25::DOUBLE + 0.25::DOUBLE * (user_id % 3) AS clat,
  -80.25::DOUBLE + 0.25::DOUBLE * ((user_id // 3) % 3) AS clon, date_trunc('hour', ts) AS ts,
  max(value % 40) AS wind, sum(value % 3) AS precip, avg(value % 30) AS temp,
  avg(value % 100) AS cloud, avg(value % 80) AS humid FROM events GROUP BY ALL""",
    "eligible": """
 SELECT c.*, l.lat, l.lon, l.is_hotspot FROM checklists c JOIN locations l USING (loc_id)
 WHERE all_reported AND protocol_id IN ('P21','P22') AND obs_time IS NOT NULL AND n_observers <= 10
  AND duration_hrs BETWEEN 0.08::DOUBLE AND 5.0::DOUBLE""",
    "spanned": """
 SELECT *, d24 + floor(hour)::BIGINT AS h_lo,
  d24 + ceil(round((hour + duration_hrs) * 3600.0::DOUBLE, 6) / 3600.0::DOUBLE)::BIGINT AS h_hi
 FROM (SELECT *, round_even(lat / 0.25::DOUBLE, 0) * 0.25::DOUBLE AS clat,
   round_even(lon / 0.25::DOUBLE, 0) * 0.25::DOUBLE AS clon,
   CAST(split_part(obs_time, ':', 1) AS DOUBLE)
    + CAST(split_part(obs_time, ':', 2) AS DOUBLE) / 60.0::DOUBLE AS hour,
   date_diff('day', DATE '1970-01-01', obs_date) * 24 AS d24 FROM eligible)""",
    "wx": """
 SELECT *, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS h FROM weather""",
    "wagg": """
 SELECT s.sub_id, max(w.wind) AS wind_max, coalesce(sum(w.precip), 0) AS precip_sum,
  avg(w.temp) AS temp_mean, avg(w.cloud) AS cloud_mean, avg(w.humid) AS humid_mean,
  count(w.ts) AS n_wx_hours
 FROM spanned s LEFT JOIN wx w ON w.clat = s.clat AND w.clon = s.clon AND w.h BETWEEN s.h_lo AND s.h_hi
 GROUP BY s.sub_id""",
    "richness": """
 SELECT sub_id, count(*) AS richness FROM observations WHERE species_code NOT LIKE 'y00%' GROUP BY 1""",
    "model": """
 SELECT s.*, w.wind_max, w.precip_sum, w.temp_mean, w.cloud_mean, w.humid_mean, w.n_wx_hours,
  coalesce(r.richness, 0) AS richness, dayofyear(obs_date) AS doy, ln(duration_hrs) AS log_dur,
  ln(1 + coalesce(distance_km, 0)) AS log_dist, CAST(protocol_id = 'P22' AS INTEGER) AS traveling,
  CAST(round_even(hour, 0) AS INTEGER) AS hr, dayofyear(obs_date) // 7 AS week,
  CASE WHEN is_hotspot THEN loc_id ELSE 'PERSONAL' END AS site
 FROM spanned s JOIN wagg w USING (sub_id) LEFT JOIN richness r USING (sub_id)""",
    "floor_species": """
 SELECT species_code, count(*) AS detections FROM observations
 WHERE species_code NOT LIKE 'y00%' GROUP BY 1 HAVING count(*) >= 200""",
    "labels_long": """
 SELECT m.sub_id, m.okey, m.loc_id, m.obs_date, f.species_code,
  CAST(o.sub_id IS NOT NULL AS INTEGER) AS y
 FROM model m CROSS JOIN floor_species f
 LEFT JOIN observations o ON o.sub_id = m.sub_id AND o.species_code = f.species_code""",
    "species": """
 SELECT species_code, CAST(substr(species_code, 3) AS INTEGER) AS sno, count(*) AS detections
 FROM observations WHERE species_code NOT LIKE 'y00%' GROUP BY 1, 2""",
    "hour_n": """
 SELECT CAST(round_even(CAST(split_part(obs_time, ':', 1) AS DOUBLE)
  + CAST(split_part(obs_time, ':', 2) AS DOUBLE) / 60, 0) AS INTEGER) AS hr, count(*) AS n
 FROM checklists WHERE obs_time IS NOT NULL GROUP BY 1""",
    "coefs": """
 SELECT species_code, term, CAST((sno * 31 + tno * 17) % 200 - 100 AS DOUBLE)
   / CASE WHEN tno >= 6 THEN 10000.0::DOUBLE ELSE 100.0::DOUBLE END AS value
  FROM species, (VALUES ('intercept', 1), ('log_dur', 2), ('log_dist', 3), ('n_observers', 4),
   ('traveling', 5), ('wind_max', 6), ('temp_mean', 7), ('precip_sum', 8), ('cloud_mean', 9)) t(term, tno)
 UNION ALL SELECT species_code, 'hour_'||lpad(CAST(hr AS VARCHAR), 2, '0'),
  CAST((sno * 31 + hr * 13) % 200 - 100 AS DOUBLE) / 100.0::DOUBLE FROM species, hour_n
 UNION ALL SELECT species_code, 'support_'||lpad(CAST(hr AS VARCHAR), 2, '0'),
  CAST(CASE WHEN hr = sno % 15 + 6 THEN 10 ELSE n END AS DOUBLE) FROM species, hour_n
 UNION ALL SELECT species_code, 'week_'||lpad(CAST(w AS VARCHAR), 2, '0'),
  CAST((sno * 31 + w * 19) % 200 - 100 AS DOUBLE) / 100.0::DOUBLE
  FROM species, (SELECT DISTINCT dayofyear(obs_date) // 7 AS w FROM checklists) WHERE w <> sno % 5
 UNION ALL SELECT species_code, 'site_'||loc_id,
  CAST((sno * 31 + CAST(substr(loc_id, 2) AS BIGINT) * 17) % 200 - 100 AS DOUBLE) / 100.0::DOUBLE
  FROM species, locations WHERE is_hotspot AND (CAST(substr(loc_id, 2) AS BIGINT) + sno) % 7 <> 0
 UNION ALL SELECT species_code, 'site_PERSONAL', CAST(sno % 10 AS DOUBLE) / 10.0::DOUBLE FROM species
 UNION ALL SELECT species_code, 'meta_detections', CAST(detections AS DOUBLE) FROM species
 UNION ALL SELECT species_code, t.term, CAST(a + sno % 40 AS DOUBLE) / 100.0::DOUBLE
  FROM species, (VALUES ('meta_by_date_auc', 50, 0), ('meta_by_date_brier', 7, 0),
   ('meta_by_date_cal_mae', 3, 0), ('meta_by_site_auc', 40, 9), ('meta_by_site_brier', 9, 9),
   ('meta_by_site_cal_mae', 5, 9)) t(term, a, m) WHERE m = 0 OR sno % 9 <> 0""",
    "refit": """
 SELECT species_code, term, value + 1 AS value FROM coefs
 WHERE CAST(substr(species_code, 3) AS INTEGER) % 2 = 0 AND NOT starts_with(term, 'hour_')""",
    "hotspots": """
 SELECT loc_id, lat, lon, round_even(lat / 0.25::DOUBLE, 0) * 0.25::DOUBLE AS clat,
  round_even(lon / 0.25::DOUBLE, 0) * 0.25::DOUBLE AS clon FROM locations WHERE is_hotspot""",
    "site_names": """
 SELECT l.loc_id, s_name AS name, lat AS latitude, lon AS longitude
 FROM supplier JOIN locations l ON l.loc_id = 'H'||s_suppkey WHERE s_acctbal < 9000""",
    "fdays": """
 SELECT DISTINCT clat, clon, day FROM (SELECT clat, clon, CAST(ts AS DATE) AS day,
  dense_rank() OVER (PARTITION BY clat, clon ORDER BY CAST(ts AS DATE)) AS rk FROM weather)
 WHERE rk <= 7""",
    "spans": """
 SELECT d.clat, d.clon, d.day, h.hour, max(w.wind) AS wind_max, avg(w.temp) AS temp_mean,
  sum(w.precip) AS precip_sum, avg(w.cloud) AS cloud_mean, count(w.ts) AS n_hours
 FROM fdays d CROSS JOIN (SELECT unnest(range(6, 21)) AS hour) h
 LEFT JOIN weather w ON w.clat = d.clat AND w.clon = d.clon AND CAST(w.ts AS DATE) = d.day
  AND hour(w.ts) = h.hour GROUP BY ALL""",
    "spans3": """
 SELECT d.clat, d.clon, d.day, h.hour, max(w.wind) AS wind_max, avg(w.temp) AS temp_mean,
  sum(w.precip) AS precip_sum, avg(w.cloud) AS cloud_mean, count(w.ts) AS n_hours
 FROM fdays d CROSS JOIN (SELECT unnest(range(6, 21)) AS hour) h
 LEFT JOIN weather w ON w.clat = d.clat AND w.clon = d.clon AND CAST(w.ts AS DATE) = d.day
  AND hour(w.ts) BETWEEN h.hour AND h.hour + 2 GROUP BY ALL""",
    "scal": """
 SELECT species_code, max(value) FILTER (term = 'intercept') AS b0,
  max(value) FILTER (term = 'log_dur') AS b_dur, max(value) FILTER (term = 'log_dist') AS b_dist,
  max(value) FILTER (term = 'n_observers') AS b_obs, max(value) FILTER (term = 'traveling') AS b_trav,
  max(value) FILTER (term = 'wind_max') AS b_wind, max(value) FILTER (term = 'temp_mean') AS b_temp,
  max(value) FILTER (term = 'precip_sum') AS b_rain, max(value) FILTER (term = 'cloud_mean') AS b_cloud
 FROM coefs GROUP BY 1""",
    "cells": """
 SELECT b.*, s.loc_id, p.day, p.hour, p.wind_max, p.temp_mean, p.precip_sum, p.cloud_mean, p.n_hours,
  hr.value AS hour_term, ref.value AS ref_term, su.value AS support, wk.value AS week_term,
  own.value IS NOT NULL AS has_site_effect, coalesce(own.value, pool.value, 0) AS site_effect
 FROM scal b CROSS JOIN hotspots s LEFT JOIN spans p ON p.clat = s.clat AND p.clon = s.clon
 LEFT JOIN coefs hr ON hr.species_code = b.species_code AND hr.term = 'hour_'||lpad(CAST(p.hour AS VARCHAR), 2, '0')
 LEFT JOIN coefs ref ON ref.species_code = b.species_code AND ref.term = 'hour_10'
 LEFT JOIN coefs su ON su.species_code = b.species_code AND su.term = 'support_'||lpad(CAST(p.hour AS VARCHAR), 2, '0')
 LEFT JOIN coefs wk ON wk.species_code = b.species_code AND wk.term = 'week_'||lpad(CAST(dayofyear(p.day) // 7 AS VARCHAR), 2, '0')
 LEFT JOIN coefs own ON own.species_code = b.species_code AND own.term = 'site_'||s.loc_id
 LEFT JOIN coefs pool ON pool.species_code = b.species_code AND pool.term = 'site_PERSONAL'""",
    "grid": """
 SELECT *, CASE WHEN reason IS NULL THEN 1 / (1 + exp(-(b0 + coalesce(hour_term, 0) + week_term
   + b_dur * ln(1.0::DOUBLE) + b_dist * ln(2.0::DOUBLE) + b_obs + b_trav + b_wind * wind_max
   + b_temp * temp_mean + b_rain * precip_sum + b_cloud * cloud_mean + site_effect))) END AS probability
 FROM (SELECT *, CASE WHEN coalesce(n_hours, 0) = 0
   OR wind_max IS NULL OR temp_mean IS NULL OR precip_sum IS NULL OR cloud_mean IS NULL THEN 'forecast' WHEN coalesce(support, 0) < 50 THEN 'hour'
   WHEN week_term IS NULL THEN 'week' END AS reason FROM cells)""",
    "best": """
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY species_code, loc_id
  ORDER BY round(probability, 9) DESC, day, hour) AS rn FROM grid WHERE probability IS NOT NULL) WHERE rn = 1""",
    "ranked_sites": """
 SELECT *, row_number() OVER (PARTITION BY species_code, day, hour ORDER BY round(probability, 9) DESC, loc_id) AS rank,
  min(probability) OVER s AS lo, max(probability) OVER s AS hi, count(*) OVER s AS n_scored
 FROM grid WHERE probability IS NOT NULL WINDOW s AS (PARTITION BY species_code, day, hour)""",
    "site_test": """
 SELECT loc_id, row_number() OVER (ORDER BY md5(loc_id||':0')) <= ceil(count(*) OVER () * 0.25) AS is_test
 FROM (SELECT DISTINCT loc_id FROM model)""",
    "date_test": """
 SELECT obs_date, row_number() OVER (ORDER BY md5(CAST(obs_date AS VARCHAR)||':0'))
  <= ceil(count(*) OVER () * 0.25) AS is_test FROM (SELECT DISTINCT obs_date FROM model)""",
    "whole": """
 SELECT * FROM model WHERE n_wx_hours > 0 AND wind_max IS NOT NULL AND temp_mean IS NOT NULL
  AND cloud_mean IS NOT NULL AND humid_mean IS NOT NULL""",
    "fit_rows": """
 SELECT * FROM whole WHERE hr IN (SELECT hr FROM whole GROUP BY hr HAVING count(*) >= 50)""",
    "fit_species": """
 SELECT species_code FROM observations JOIN floor_species USING (species_code)
 WHERE sub_id IN (SELECT sub_id FROM fit_rows) GROUP BY 1 HAVING count(*) >= 200""",
    "fit_labels": """
 SELECT m.*, f.species_code, CAST(o.sub_id IS NOT NULL AS INTEGER) AS y
 FROM fit_rows m CROSS JOIN fit_species f
 LEFT JOIN observations o ON o.sub_id = m.sub_id AND o.species_code = f.species_code""",
    "fit_site_test": """
 SELECT loc_id, row_number() OVER (ORDER BY md5(loc_id||':0')) <= ceil(count(*) OVER () * 0.25) AS is_test
 FROM (SELECT DISTINCT loc_id FROM fit_rows)""",
    "fit_date_test": """
 SELECT obs_date, row_number() OVER (ORDER BY md5(CAST(obs_date AS VARCHAR)||':0'))
  <= ceil(count(*) OVER () * 0.25) AS is_test FROM (SELECT DISTINCT obs_date FROM fit_rows)""",
    "hour_labels": """
 SELECT m.hr, CAST(o.sub_id IS NOT NULL AS INTEGER) AS y
 FROM (SELECT * FROM whole WHERE hr IN (SELECT hr FROM whole WHERE hr BETWEEN 5 AND 20
  GROUP BY hr HAVING count(*) >= 50)) m
 LEFT JOIN observations o ON o.sub_id = m.sub_id AND o.species_code = (
  SELECT species_code FROM observations JOIN whole USING (sub_id)
  WHERE species_code NOT LIKE 'y00%' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""",
    "hour_counts": """
 SELECT hr, CAST(sum(y) AS DOUBLE) AS a, CAST(sum(1 - y) AS DOUBLE) AS b FROM hour_labels GROUP BY 1""",
    "hour_seen": """
 SELECT m.*, CAST(o.sub_id IS NOT NULL AS INTEGER) AS y FROM whole m
 LEFT JOIN observations o ON o.sub_id = m.sub_id AND o.species_code = (
  SELECT species_code FROM observations JOIN whole USING (sub_id)
  WHERE species_code NOT LIKE 'y00%' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""",
    "hour_fits": """
 SELECT 'day' AS rows_of, * FROM hour_seen WHERE hr IN (
  SELECT hr FROM hour_seen WHERE hr BETWEEN 5 AND 20 GROUP BY hr HAVING count(*) >= 50)
 UNION ALL SELECT 'example', * FROM hour_seen WHERE hr IN (SELECT hr FROM hour_seen GROUP BY hr HAVING count(*) >= 50)""",
    "hour_knots": """
 SELECT rows_of, CAST(min(doy) AS DOUBLE) AS d_lo, CAST(max(doy) AS DOUBLE) AS d_hi, min(hour) AS t_lo,
  quantile_cont(hour, 0.5) AS t_mid, max(hour) AS t_hi, list_sort(list(DISTINCT hr)) AS hours
 FROM hour_fits GROUP BY 1""",
    "glm_rows": f"""
 SELECT fit, CAST(y AS DOUBLE) AS y, [1.0::DOUBLE, log_dur, log_dist, {", ".join(spline_sql("doy", ["d_lo"] * 4 + ["d_hi"] * 4))},
  wind_max, temp_mean, precip_sum] || CASE WHEN fit = 'spline'
  THEN [{", ".join(spline_sql("hour", ["t_lo"] * 4 + ["t_mid"] + ["t_hi"] * 4))}]
  ELSE list_transform(list_filter(hours, lambda h: h <> 8), lambda h: CAST(h = hr AS INTEGER)::DOUBLE) END AS v
 FROM hour_fits JOIN hour_knots USING (rows_of)
 JOIN (VALUES ('dummy', 'day'), ('spline', 'day'), ('example', 'example')) f(fit, rows_of) USING (rows_of)""",
    # Newton's method: each round sums the weighted cross products and eliminates
    "glm": """
 WITH RECURSIVE step(it, fit, b, var, ll) AS (
  SELECT 0, fit, list_transform(range(0, any_value(len(v))), lambda i: 0.0::DOUBLE), NULL::DOUBLE[], NULL::DOUBLE
  FROM glm_rows GROUP BY fit
  UNION ALL
  SELECT it + 1, fit, list_transform(b, lambda x, i: x + m[i][len(b) + 1]),
   list_transform(b, lambda x, i: m[i][len(b) + 1 + i]), ll
  FROM (SELECT it, fit, any_value(b) AS b, any_value(ll) AS ll,
    list_reduce([{'k': 0, 'm': list(line ORDER BY i)}] || list_transform(range(1, any_value(len(b)) + 1),
     lambda k: {'k': k, 'm': [[0.0::DOUBLE]]}), lambda a, x: {'k': x.k, 'm': list_transform(a.m, lambda r, i:
      CASE WHEN i = x.k THEN list_transform(r, lambda c: c / r[x.k])
       ELSE list_transform(r, lambda c, j: c - r[x.k] * a.m[x.k][j] / a.m[x.k][x.k]) END)}).m AS m
   FROM (SELECT it, fit, i, any_value(b) AS b, any_value(ll) AS ll, list(h ORDER BY j) || [any_value(g)]
      || list_transform(range(1, any_value(len(b)) + 1), lambda k: CASE WHEN k = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS line
    FROM (SELECT it, fit, i, j, any_value(b) AS b, sum(p * (1 - p) * v[i] * v[j]) AS h, sum((y - p) * v[i]) AS g,
      sum(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS ll
     FROM (SELECT s.it, s.fit, s.b, d.v, d.y, 1 / (1 + exp(-list_dot_product(d.v, s.b))) AS p
       FROM step s JOIN glm_rows d ON d.fit = s.fit WHERE s.it < 9) r,
      (SELECT unnest(range(1, 40)) AS i) x, (SELECT unnest(range(1, 40)) AS j) z
     WHERE i <= len(v) AND j <= len(v) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) GROUP BY 1, 2))
 SELECT fit, b, var, ll FROM step WHERE it = 9""",
    "scored": """
 SELECT split, species_code, y, (CAST((okey * 37 + CAST(substr(species_code, 3) AS INTEGER) * 101) % 1000 AS DOUBLE)
   + 0.5::DOUBLE) / 1000.0::DOUBLE AS p
 FROM (SELECT 'by_site' AS split, l.* FROM labels_long l JOIN site_test USING (loc_id) WHERE is_test
  UNION ALL SELECT 'by_date', l.* FROM labels_long l JOIN date_test USING (obs_date) WHERE is_test)""",
    "edges": """
 SELECT split, species_code, list_sort(list_distinct([
  CASE WHEN ((n - 1) * k) % 10 = 0 THEN ps[((n - 1) * k) // 10 + 1]
  ELSE ps[((n - 1) * k) // 10 + 1] + (ps[((n - 1) * k) // 10 + 2] - ps[((n - 1) * k) // 10 + 1])
   * (CAST(((n - 1) * k) % 10 AS DOUBLE) / 10.0::DOUBLE) END FOR k IN range(0, 11)])) AS e
 FROM (SELECT split, species_code, list_sort(list(p)) AS ps, count(*) AS n FROM scored GROUP BY 1, 2)""",
    "calibration": """
 SELECT split, species_code, bin, avg(p) AS pred, avg(CAST(y AS DOUBLE)) AS obs, count(*) AS n
 FROM (SELECT s.*, greatest(len([x FOR x IN e IF x < s.p]), 1) - 1 AS bin
  FROM scored s JOIN edges USING (split, species_code) WHERE len(e) > 1) GROUP BY 1, 2, 3""",
    "cal_mae": """
 SELECT split, species_code, avg(abs(obs - pred)) AS cal_mae FROM calibration GROUP BY 1, 2""",
    "auc": """
 SELECT split, species_code, count(*) AS n, sum(y) AS n_pos, avg(pow(p - y, 2)) AS brier,
  (sum(mid) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc
 FROM (SELECT *, rank() OVER (PARTITION BY split, species_code ORDER BY p)
  + (count(*) OVER (PARTITION BY split, species_code, p) - 1) / 2.0::DOUBLE AS mid FROM scored) GROUP BY 1, 2""",
    "ap": """
 SELECT split, species_code, sum(pos * 1.0::DOUBLE / total * hits / above) AS avg_precision
 FROM (SELECT *, sum(pos) OVER (PARTITION BY split, species_code) AS total,
   sum(pos) OVER w AS hits, sum(n) OVER w AS above
  FROM (SELECT split, species_code, p, count(*) AS n, sum(y) AS pos FROM scored GROUP BY 1, 2, 3)
  WINDOW w AS (PARTITION BY split, species_code ORDER BY p DESC)) GROUP BY 1, 2""",
    "metrics": """
 SELECT a.split, a.species_code, a.n, a.n_pos, CASE WHEN ok THEN brier END AS brier,
  CASE WHEN ok THEN auc END AS auc, CASE WHEN ok THEN avg_precision END AS avg_precision,
  CASE WHEN ok THEN cal_mae END AS cal_mae
 FROM (SELECT *, n_pos > 0 AND n_pos < n AS ok FROM auc) a JOIN ap USING (split, species_code)
 LEFT JOIN cal_mae USING (split, species_code)""",
    "photos": r"""
 SELECT p_partkey % 37 AS taxon_id, p_partkey AS photo_id,
  'https://photos.example.org/'||p_partkey||'/square.jpg' AS url,
  (['cc0','cc-by','cc-by-sa','cc-by-nd','cc-by-nc','cc-by-nc-sa','cc-by-nc-nd','all-rights',NULL])[p_partkey % 9 + 1] AS licence,
  ' (c)  '||p_name||chr(10)||chr(9)||p_brand AS attribution, p_size % 13 = 0 AS is_curated,
  p_partkey AS position, CASE WHEN p_type = 'SMALL' THEN 'casual' ELSE 'research' END AS quality_grade,
  p_retailprice AS votes, p_size % 13 AS month, p_size % 2 = 1 AS is_female FROM part""",
    "photo_slots": r"""
 SELECT taxon_id, slot, photo_id, replace(url, '/square.', '/medium.') AS url, licence,
  trim(regexp_replace(attribution, '\s+', ' ', 'g')) AS attribution FROM (
  SELECT *, 'main_'||row_number() OVER (PARTITION BY taxon_id ORDER BY position) AS slot,
   row_number() OVER (PARTITION BY taxon_id ORDER BY position) <= 3 AS keep
  FROM photos WHERE is_curated AND licence IS NOT NULL
  UNION ALL
  SELECT *, 'month_'||lpad(CAST(month AS VARCHAR), 2, '0'),
   row_number() OVER (PARTITION BY taxon_id, month ORDER BY votes DESC, photo_id) = 1
  FROM photos WHERE NOT is_curated AND month BETWEEN 1 AND 12 AND quality_grade = 'research'
   AND licence IS NOT NULL AND licence <> 'all-rights'
  UNION ALL
  SELECT *, 'female', row_number() OVER (PARTITION BY taxon_id ORDER BY votes DESC, photo_id) = 1
  FROM photos WHERE NOT is_curated AND is_female AND quality_grade = 'research'
   AND licence IS NOT NULL AND licence <> 'all-rights') WHERE keep""",
    "sightings": """
 SELECT o.sub_id, o.species_code, c.obs_date, l.lat, l.lon FROM observations o
 JOIN checklists c USING (sub_id) JOIN locations l USING (loc_id) WHERE o.species_code NOT LIKE 'y00%'""",
    "pins": """
 SELECT c_name AS point_id, 'sp'||lpad(CAST(c_custkey % 37 + 3 AS VARCHAR), 2, '0') AS species_code,
  40.19::DOUBLE + CAST(c_custkey % 50 AS DOUBLE) / 100.0::DOUBLE + CAST(c_custkey % 7 AS DOUBLE) / 10000.0::DOUBLE AS lat,
  -80.34::DOUBLE + CAST((c_custkey * 3) % 66 AS DOUBLE) / 100.0::DOUBLE + CAST(c_custkey % 11 AS DOUBLE) / 10000.0::DOUBLE AS lon
 FROM customer""",
    "requests": """
 SELECT c_name AS request_id, 'sp'||lpad(CAST(c_custkey % 39 + 2 AS VARCHAR), 2, '0') AS species_code, lat, lon,
  round_even(lat / 0.25::DOUBLE, 0) * 0.25::DOUBLE AS clat, round_even(lon / 0.25::DOUBLE, 0) * 0.25::DOUBLE AS clon,
  CASE WHEN c_custkey % 4 = 0 THEN 'H'||(c_custkey // 15) END AS named,
  CASE WHEN c_custkey % 31 <> 0 THEN CAST(c_custkey % 6 + 1 AS DOUBLE) / 2.0::DOUBLE END AS duration_hrs,
  CAST(c_custkey % 5 AS DOUBLE) / 2.0::DOUBLE AS distance_km, c_custkey % 4 + 1 AS n_observers,
  c_custkey % 2 AS traveling FROM customer JOIN pins ON point_id = c_name""",
    "placed": """
 SELECT r.*, b.* EXCLUDE (species_code), CASE WHEN refused IS NULL THEN coalesce(named, n.loc_id) ELSE named END AS loc_id,
  coalesce(refused, CASE WHEN b.species_code IS NULL THEN 'species' END) AS refusal
 FROM (SELECT *, CASE WHEN NOT (lat BETWEEN 40.19::DOUBLE AND 40.68::DOUBLE AND lon BETWEEN -80.34::DOUBLE AND -79.69::DOUBLE)
   THEN 'area' WHEN duration_hrs IS NULL THEN 'outing' END AS refused FROM requests) r
 LEFT JOIN (SELECT * FROM near WHERE rank = 1 AND distance_km <= 0.2) n ON n.point_id = r.request_id
 LEFT JOIN scal b ON b.species_code = r.species_code""",
    "spansn": """
 SELECT d.clat, d.clon, d.day, h.hour, n, max(w.wind) AS wind_max, avg(w.temp) AS temp_mean,
  sum(w.precip) AS precip_sum, avg(w.cloud) AS cloud_mean, count(w.ts) AS n_hours
 FROM fdays d CROSS JOIN (SELECT unnest(range(6, 21)) AS hour) h CROSS JOIN (SELECT unnest(range(1, 4)) AS n)
 LEFT JOIN weather w ON w.clat = d.clat AND w.clon = d.clon AND CAST(w.ts AS DATE) = d.day
  AND hour(w.ts) BETWEEN h.hour AND h.hour + n - 1 GROUP BY ALL""",
    "asked_cells": """
 SELECT r.*, p.day, p.hour, p.wind_max, p.temp_mean, p.precip_sum, p.cloud_mean, hr.value AS hour_term,
  ref.value AS ref_term, wk.value AS week_term, own.value IS NOT NULL AS has_site_effect,
  coalesce(own.value, pool.value, 0) AS site_effect, coalesce(refusal, CASE WHEN coalesce(n_hours, 0) = 0
   OR wind_max IS NULL OR temp_mean IS NULL OR precip_sum IS NULL OR cloud_mean IS NULL THEN 'forecast'
   WHEN coalesce(su.value, 0) < 50 THEN 'hour' WHEN wk.value IS NULL THEN 'week' END) AS reason
 FROM placed r LEFT JOIN spansn p ON refusal IS NULL AND p.clat = r.clat AND p.clon = r.clon AND p.n = ceil(r.duration_hrs)
 LEFT JOIN coefs hr ON hr.species_code = r.species_code AND hr.term = 'hour_'||lpad(CAST(p.hour AS VARCHAR), 2, '0')
 LEFT JOIN coefs ref ON ref.species_code = r.species_code AND ref.term = 'hour_10'
 LEFT JOIN coefs su ON su.species_code = r.species_code AND su.term = 'support_'||lpad(CAST(p.hour AS VARCHAR), 2, '0')
 LEFT JOIN coefs wk ON wk.species_code = r.species_code AND wk.term = 'week_'||lpad(CAST(dayofyear(p.day) // 7 AS VARCHAR), 2, '0')
 LEFT JOIN coefs own ON own.species_code = r.species_code AND own.term = 'site_'||r.loc_id
 LEFT JOIN coefs pool ON pool.species_code = r.species_code AND pool.term = 'site_PERSONAL'""",
    "asked_grid": """
 SELECT *, CASE WHEN reason IS NULL THEN 1 / (1 + exp(-(b0 + coalesce(hour_term, 0) + week_term
   + b_dur * ln(duration_hrs) + b_dist * ln(1 + distance_km) + b_obs * n_observers + b_trav * traveling
   + b_wind * wind_max + b_temp * temp_mean + b_rain * precip_sum + b_cloud * cloud_mean + site_effect))) END
  AS probability FROM asked_cells""",
    "asked_best": """
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id
  ORDER BY round(probability, 9) DESC, day, hour) AS rn FROM asked_grid WHERE probability IS NOT NULL) WHERE rn = 1""",
    "refit_counts": """
 SELECT split, species_code, count(*) AS n, sum(y) AS pos FROM (
  SELECT 'by_site' AS split, l.* FROM fit_labels l JOIN fit_site_test USING (loc_id) WHERE is_test
  UNION ALL SELECT 'by_date', l.* FROM fit_labels l JOIN fit_date_test USING (obs_date) WHERE is_test) GROUP BY 1, 2""",
    "published": """
 SELECT species_code, term, CAST(NULL AS DOUBLE) AS value FROM (SELECT DISTINCT species_code, unnest(['intercept', 'log_dur',
   'log_dist', 'n_observers', 'traveling', 'wind_max', 'temp_mean', 'precip_sum', 'cloud_mean',
   'hour_'||lpad(CAST(hr AS VARCHAR), 2, '0'), 'week_'||lpad(CAST(week AS VARCHAR), 2, '0'), 'site_'||site]) AS term
  FROM fit_labels)
 UNION ALL SELECT species_code, 'support_'||lpad(CAST(hr AS VARCHAR), 2, '0'), CAST(count(*) AS DOUBLE)
  FROM fit_labels GROUP BY species_code, hr
 UNION ALL SELECT species_code, 'meta_detections', CAST(sum(y) AS DOUBLE) FROM fit_labels GROUP BY 1
 UNION ALL SELECT species_code, 'meta_'||split||'_'||m, NULL FROM refit_counts, (SELECT unnest(['brier', 'auc', 'cal_mae']) AS m)
  WHERE pos > 0 AND pos < n
 UNION ALL SELECT species_code, term, value FROM coefs WHERE species_code NOT IN (SELECT species_code FROM fit_species)""",
    "logged": """
 SELECT 'A'||o_orderkey AS outing_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'driving'
   WHEN o_orderstatus = 'O' THEN 'stationary' WHEN o_orderstatus = 'F' THEN 'traveling'
   ELSE 'incidental' END AS protocol,
  CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey % 800 END AS duration_min,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(CAST(o_orderkey % 50 - 2 AS DOUBLE) / 4.0::DOUBLE AS DECIMAL(6,2)) END AS distance_km,
  CASE WHEN o_orderkey % 12 <> 0 THEN o_orderkey % 55 END AS party_size FROM orders""",
    "near": """
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(distance_km, 9), loc_id) AS rank
  FROM (SELECT p.point_id, h.loc_id, 2 * 6371.0088::DOUBLE * asin(sqrt(least(1.0::DOUBLE,
    pow(sin(radians(h.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(h.lat))
    * pow(sin(radians(h.lon - p.lon) / 2), 2)))) AS distance_km FROM pins p CROSS JOIN hotspots h))""",
}


SQL |= {
    "asked_places": """
 SELECT point_id, CAST(regexp_extract(point_id, '(\\d+)$', 1) AS BIGINT) AS k,
  round_even(lat * 10, 0) / 10 AS blat, round_even(lon * 10, 0) / 10 AS blon FROM pins""",
    # an answer of the 20th still holds on the 23rd, not on the 24th
    "place_answers": """
 SELECT blat, blon, CASE WHEN bool_or(k % 50 < 30) AND NOT bool_or(k % 50 < 15) THEN DATE '2024-01-23'
  ELSE DATE '2024-01-24' END AS answered_on FROM asked_places GROUP BY 1, 2""",
    "seen_around": """
 SELECT blat, blon, answered_on, species_code, max(obs_date) AS last_seen, CAST(count(*) AS BIGINT) AS n_lists
 FROM place_answers JOIN sightings s ON s.obs_date BETWEEN answered_on - 14 AND answered_on
 WHERE 2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin(radians(s.lat - blat) / 2), 2)
   + cos(radians(blat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - blon) / 2), 2))) <= 25 GROUP BY 1, 2, 3, 4""",
    "filed": """
 SELECT okey, obs_date, unnest(CASE WHEN okey % 13 = 0 THEN [w, w + 1] ELSE [w] END) AS wave
 FROM (SELECT okey, obs_date, (dayofmonth(obs_date) - 1) // 10
  + CASE WHEN okey % 11 = 0 THEN 2 WHEN okey % 7 = 0 THEN 1 ELSE 0 END AS w FROM checklists)""",
    # where the watermark stands once a wave has been read
    "marks": """
 SELECT wave, max(max(obs_date)) OVER (ORDER BY wave) - 7 AS mark FROM filed GROUP BY 1""",
    "rolled_weather": """
 SELECT clat, clon, ts, wind + CASE WHEN (dayofmonth(ts) + hour(ts)) % 9 = 0 THEN 3 ELSE 0 END AS wind,
  precip, temp, cloud, humid FROM weather WHERE ts >= TIMESTAMP '2024-01-03'""",
}
# the grid of the second snapshot, computed as a whole
for _name, _new in (("fdays", "rolled_days"), ("spans", "rolled_spans"), ("cells", "rolled_cells"), ("grid", "rolled_grid")):
    _body = SQL[_name]
    for _old, _to in (("weather", "rolled_weather"), ("fdays", "rolled_days"), ("spans", "rolled_spans"),
                      ("cells", "rolled_cells")):
        _body = re.sub(rf"\b(FROM|JOIN) {_old}\b", rf"\1 {_to}", _body)
    SQL[_new] = _body

# the same metrics of models with one level per hour, whose scores are shares
SQL["level_scored"] = " UNION ALL ".join(f"""
 SELECT 'by_{split}' AS split, t.species_code, t.y, round(coalesce(m.p, f.p), 9) AS p
 FROM (SELECT * FROM fit_labels JOIN fit_{split}_test USING ({key}) WHERE is_test) t
 LEFT JOIN (SELECT species_code, hr, avg(y) AS p FROM fit_labels JOIN fit_{split}_test USING ({key})
  WHERE NOT is_test GROUP BY 1, 2) m USING (species_code, hr)
 JOIN (SELECT species_code, avg(y) AS p FROM fit_labels JOIN fit_{split}_test USING ({key})
  WHERE NOT is_test AND hr = (SELECT min(hr) FROM fit_labels JOIN fit_{split}_test USING ({key}) WHERE NOT is_test)
  GROUP BY 1) f ON f.species_code = t.species_code""" for split, key in (("site", "loc_id"), ("date", "obs_date")))
for _name in ("edges", "calibration", "cal_mae", "auc", "ap", "metrics"):
    SQL[f"level_{_name}"] = re.sub(r"\b(FROM|JOIN) (scored|edges|calibration|cal_mae|auc|ap)\b", r"\1 level_\2",
                                   SQL[_name])


def with_tables(body: str) -> str:
    """``body`` with the definitions it names, and those they name."""
    need: list[str] = []
    open_: set[str] = set()

    def visit(text: str) -> None:
        for name in SQL:
            if name in open_:
                continue
            if re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                open_.add(name)
                visit(SQL[name])
                need.append(name)

    visit(body)
    # a definition comes after all it names
    parts = [f"{n} AS ({SQL[n]})" for n in need]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
