"""Ingest, text and status operators and their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from beatwise.checks.sql import EDITS, OUTLETS, STOPS, channel_case, minutes_case
from beatwise.functions import cycle, text
from beatwise.functions.numbers import float_prefix, int_prefix, six
from beatwise.operators import ingest, status
from beatwise.sources import testdata as td
from beatwise.sources import uploads

QUERIES, SQL = {}, {}
c = F.col


def upload(spark, sf):
    """A dirty upload: the outlet list as text, broken by key."""
    degrees = lambda e6: F.concat((F.floor(c(e6) / 1000000)).cast("string"), F.lit("."),
                                  F.lpad((c(e6) % 1000000).cast("string"), 6, "0"))
    k = c("outlet_id")
    raw = td.outlets(spark, sf).select(
        k.alias("row"), c("market_id").alias("File"),
        F.when(k % 41 == 0, "  ").otherwise(c("name")).alias("Outlet_Name"), c("code").alias("Client Code"),
        F.when(k % 43 == 0, "abc").when(k % 53 == 0, "0").when(k % 59 == 0, F.concat(degrees("lat_e6"), F.lit("N")))
         .otherwise(degrees("lat_e6")).alias("Lattitude"),
        F.when(k % 47 == 0, "200").otherwise(degrees("lng_e6")).alias("GPS Lng"),
        F.when(k % 31 == 0, F.lit(None).cast("string")).when(k % 37 == 0, "x").otherwise(c("vf").cast("string")).alias("VF"),
        c("channel").alias("Outlet Type"),
        F.when(k % 83 == 0, "500 min").otherwise(c("time_per_visit").cast("string")).alias("Call Time"),
        F.floor("value").cast("bigint").cast("string").alias("VC"))
    return uploads.normalise_headers(raw)


UPLOAD = f"""{OUTLETS},
upload AS (SELECT outlet_id AS "row", market_id AS file, CASE WHEN outlet_id % 41 = 0 THEN '  ' ELSE name END AS outletname,
  code AS clientcode,
  CASE WHEN outlet_id % 43 = 0 THEN 'abc' WHEN outlet_id % 53 = 0 THEN '0'
       ELSE (lat_e6 // 1000000) || '.' || lpad(CAST(lat_e6 % 1000000 AS VARCHAR), 6, '0')
            || CASE WHEN outlet_id % 59 = 0 THEN 'N' ELSE '' END END AS lat_t,
  CASE WHEN outlet_id % 47 = 0 THEN '200' ELSE (lng_e6 // 1000000) || '.' || lpad(CAST(lng_e6 % 1000000 AS VARCHAR), 6, '0') END AS lng_t,
  CASE WHEN outlet_id % 31 = 0 THEN NULL WHEN outlet_id % 37 = 0 THEN 'x' ELSE CAST(vf AS VARCHAR) END AS vf_t,
  channel AS type_t, CASE WHEN outlet_id % 83 = 0 THEN '500 min' ELSE CAST(time_per_visit AS VARCHAR) END AS call_t,
  CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS vc_t FROM outlets),
mapped AS (SELECT "row", file, coalesce(nullif(trim(outletname), ''), nullif(trim(clientcode), '')) AS name_text,
  nullif(trim(clientcode), '') AS code_text,
  CASE WHEN TRY_CAST(regexp_extract(lat_t, '^[0-9.]+') AS DOUBLE) BETWEEN -90 AND 90
        AND TRY_CAST(regexp_extract(lat_t, '^[0-9.]+') AS DOUBLE) <> 0 THEN lat_t END AS latitude_text,
  lng_t AS longitude_text, vf_t AS vf_text, nullif(trim(type_t), '') AS channel_text, call_t AS call_time_text, vc_t AS value_text
  FROM upload),
parsed AS (SELECT *, TRY_CAST(regexp_extract(latitude_text, '^[0-9.]+') AS DOUBLE) AS latitude,
  TRY_CAST(regexp_extract(longitude_text, '^[0-9.]+') AS DOUBLE) AS longitude FROM mapped),
valid AS (SELECT *, CASE WHEN name_text IS NULL THEN 'missing name' WHEN latitude IS NULL THEN 'missing latitude'
  WHEN longitude IS NULL OR longitude_text = '0' THEN 'missing longitude' WHEN abs(latitude) > 90 THEN 'latitude out of range'
  WHEN abs(longitude) > 180 THEN 'longitude out of range' END AS reject_reason FROM parsed),
complete AS (SELECT *, CAST(CASE WHEN vf_text IN ('1', '2', '4') THEN CAST(vf_text AS INTEGER) ELSE 2 END AS INTEGER) AS vf,
  vf_text IS NULL AS vf_assumed, {channel_case('channel_text')} AS channel_key,
  CASE WHEN TRY_CAST(regexp_extract(call_time_text, '^[0-9]+') AS INTEGER) > 0 THEN 'file'
       WHEN channel_text IS NOT NULL THEN 'channel' ELSE 'assumed' END AS call_source,
  CAST(least(180, greatest(3, coalesce(TRY_CAST(regexp_extract(call_time_text, '^[0-9]+') AS INTEGER),
    {minutes_case('(' + channel_case('channel_text') + ')')}, 15))) AS INTEGER) AS time_per_visit,
  CAST(value_text AS DOUBLE) AS value FROM valid)"""


def _mapped(spark, sf):
    return ingest.map_columns(upload(spark, sf), ("row", "file"))


def _complete(spark, sf):
    return ingest.complete(_mapped(spark, sf))


QUERIES["map_columns"] = lambda spark, sf: _mapped(spark, sf).select(
    "row", "name_text", "code_text", "vf_text", "channel_text", "call_time_text", "value_text")
SQL["map_columns"] = f"""WITH {UPLOAD} SELECT "row", name_text, code_text, vf_text, channel_text, call_time_text, value_text FROM mapped"""

QUERIES["coordinate_fallback"] = lambda spark, sf: _mapped(spark, sf).select("row", "latitude_text", "longitude_text")
SQL["coordinate_fallback"] = f"""WITH {UPLOAD} SELECT "row", latitude_text, longitude_text FROM mapped"""

QUERIES["parse_number_prefix"] = lambda spark, sf: upload(spark, sf).select(
    "row", float_prefix(c("lattitude")).alias("latitude"), int_prefix(c("calltime")).alias("minutes"))
SQL["parse_number_prefix"] = f"""WITH {UPLOAD} SELECT "row", TRY_CAST(regexp_extract(lat_t, '^[0-9.]+') AS DOUBLE) AS latitude,
  TRY_CAST(regexp_extract(call_t, '^[0-9]+') AS BIGINT) AS minutes FROM upload"""

QUERIES["validate_rows"] = lambda spark, sf: ingest.validate_rows(_mapped(spark, sf)).select(
    "row", "latitude", "longitude", "reject_reason")
SQL["validate_rows"] = f"""WITH {UPLOAD} SELECT "row", latitude, longitude, reject_reason FROM valid"""

QUERIES["reject_counts"] = lambda spark, sf: ingest.reject_counts(ingest.validate_rows(_mapped(spark, sf)), ["file"])
SQL["reject_counts"] = f"""WITH {UPLOAD} SELECT file, reject_reason, count(*) AS "rows" FROM valid WHERE reject_reason IS NOT NULL GROUP BY ALL"""

QUERIES["default_frequency"] = lambda spark, sf: _complete(spark, sf).select("row", "vf", "vf_assumed")
SQL["default_frequency"] = f"""WITH {UPLOAD} SELECT "row", vf, vf_assumed FROM complete"""

QUERIES["call_time_source"] = lambda spark, sf: _complete(spark, sf).select("row", "call_source", "time_per_visit")
SQL["call_time_source"] = f"""WITH {UPLOAD} SELECT "row", call_source, time_per_visit FROM complete"""

QUERIES["file_report"] = lambda spark, sf: ingest.file_report(_complete(spark, sf), ["file"])
SQL["file_report"] = f"""WITH {UPLOAD}, top AS (SELECT file, "row", reject_reason FROM complete WHERE reject_reason IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY file ORDER BY "row") <= 5)
SELECT file, count(*) AS "rows", count(*) FILTER (reject_reason IS NULL) AS valid, count(*) FILTER (reject_reason IS NOT NULL) AS skipped,
  count(*) FILTER (reject_reason IS NULL AND vf = 1) AS vf1, count(*) FILTER (reject_reason IS NULL AND vf = 2) AS vf2,
  count(*) FILTER (reject_reason IS NULL AND vf = 4) AS vf4, count(*) FILTER (reject_reason IS NULL AND vf_assumed) AS assumed_vf,
  count(*) FILTER (reject_reason IS NULL AND call_source = 'file') AS call_file,
  count(*) FILTER (reject_reason IS NULL AND call_source = 'channel') AS call_channel,
  count(*) FILTER (reject_reason IS NULL AND call_source = 'assumed') AS call_assumed,
  count(DISTINCT channel_key) FILTER (reject_reason IS NULL) AS channels, vf1 + 2 * vf2 + 4 * vf4 AS monthly_visits,
  CAST(ceil((vf1 + 2 * vf2 + 4 * vf4) / 540.0) AS BIGINT) AS recommended_reps,
  (SELECT string_agg(reject_reason, '; ' ORDER BY "row") FROM top WHERE top.file = complete.file) AS first_reasons
FROM complete GROUP BY file"""

QUERIES["classify_channel"] = lambda spark, sf: td.outlets(spark, sf).select(
    "outlet_id", text.classify_channel(c("channel")).alias("channel_key"), text.classify_channel(c("name")).alias("name_channel"))
SQL["classify_channel"] = f"""WITH {OUTLETS} SELECT outlet_id, {channel_case('channel')} AS channel_key, {channel_case('name')} AS name_channel FROM outlets"""

QUERIES["call_minutes"] = lambda spark, sf: td.outlets(spark, sf).select("outlet_id", "call_minutes")
SQL["call_minutes"] = f"WITH {OUTLETS} SELECT outlet_id, call_minutes FROM outlets"

LATIN_WORDS = "super ?market|mini ?market|market|center|centre|shop|store|grocery"
NORM = lambda n: (f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(lower({n}), "
                  f"'[\\x{{064B}}-\\x{{0652}}\\x{{0640}}]', '', 'g'), 'إأآةى', 'اااهي'), '\\b(?:{LATIN_WORDS})\\b', ' ', 'g'), "
                  f"'^ال', ''), '\\sال', ' ', 'g'), '[^a-z0-9\\x{{0600}}-\\x{{06FF}}]+', '', 'g')")
QUERIES["normalise_name"] = lambda spark, sf: td.outlets(spark, sf).select(
    "outlet_id", text.normalise_name(c("name")).alias("name_key"), text.script_of(c("name")).alias("script"))
SQL["normalise_name"] = f"""WITH {OUTLETS} SELECT outlet_id, {NORM('name')} AS name_key,
  CASE WHEN regexp_matches(name, '[\\x{{0600}}-\\x{{06FF}}]') AND NOT regexp_matches(name, '[A-Za-z]') THEN 'ar'
       WHEN regexp_matches(name, '[A-Za-z]') AND NOT regexp_matches(name, '[\\x{{0600}}-\\x{{06FF}}]') THEN 'la' ELSE 'mixed' END AS script FROM outlets"""

SIMILARITY = """CASE WHEN x = '' OR y = '' THEN 0.0 WHEN x = y THEN 1.0
  WHEN least(length(x), length(y)) >= 3 AND (contains(x, y) OR contains(y, x)) THEN 0.8
  WHEN length(x) + length(y) - 2 > 0 THEN 2.0 * coalesce(list_sum(list_transform(list_distinct(gx),
    lambda g: least(len(list_filter(gx, lambda h: h = g)), len(list_filter(gy, lambda h: h = g))))), 0) / (length(x) + length(y) - 2)
  ELSE 0.0 END"""


def _twins(spark, sf):
    o = td.outlets(spark, sf).select("rep_id", "outlet_id", "name", "lat_e6")
    nxt = o.select("rep_id", (c("outlet_id") - 1).alias("outlet_id"), c("name").alias("other"))
    return o.join(nxt, ["rep_id", "outlet_id"])


QUERIES["name_similarity"] = lambda spark, sf: _twins(spark, sf).select(
    "outlet_id", six(text.name_similarity(c("name"), c("other"))).alias("similarity"))
SQL["name_similarity"] = f"""WITH {OUTLETS}, t AS (SELECT a.outlet_id, {NORM('a.name')} AS x, {NORM('b.name')} AS y
  FROM outlets a JOIN outlets b ON b.outlet_id = a.outlet_id + 1 AND a.rep_id = b.rep_id),
g AS (SELECT *, list_transform(range(1, length(x)), lambda i: substr(x, i, 2)) AS gx,
  list_transform(range(1, length(y)), lambda i: substr(y, i, 2)) AS gy FROM t)
SELECT outlet_id, round({SIMILARITY}, 6) AS similarity FROM g"""


def _files(spark, sf):
    return td.outlets(spark, sf).select("outlet_id", F.when(c("outlet_id") % 3 == 0, F.concat(c("name"), F.lit(".xlsx")))
                                        .when(c("outlet_id") % 3 == 1, F.concat(c("name"), F.lit(" Universe Edited v."),
                                                                               (c("outlet_id") % 10).cast("string"), F.lit(".CSV")))
                                        .otherwise(F.lit(".csv")).alias("file"))


QUERIES["file_version"] = lambda spark, sf: _files(spark, sf).select(
    "outlet_id", text.file_base(c("file")).alias("base"), text.file_version(c("file")).alias("version"),
    text.edited_file_name(text.file_base(c("file")), text.file_version(c("file")) + 1).alias("next_name"))
SQL["file_version"] = f"""WITH {OUTLETS} SELECT outlet_id, CASE WHEN outlet_id % 3 = 2 THEN 'Outlets' ELSE name END AS base,
  CAST(CASE WHEN outlet_id % 3 = 1 THEN outlet_id % 10 ELSE 0 END AS INTEGER) AS version,
  CASE WHEN outlet_id % 3 = 2 THEN 'Outlets' ELSE name END || ' Universe Edited v.'
    || (CASE WHEN outlet_id % 3 = 1 THEN outlet_id % 10 ELSE 0 END + 1) || '.xlsx' AS next_name FROM outlets"""

QUERIES["parse_week"] = lambda spark, sf: td.outlets(spark, sf).select("outlet_id", F.array_join(cycle.parse_week(
    F.when(c("outlet_id") % 2 == 0, F.array((c("outlet_id") % 9).cast("string"), F.lit("1"), F.lit("3"), F.lit("x"),
                                            (c("outlet_id") % 7 + 1).cast("string"))), (c("outlet_id") % 10).cast("int")), ",").alias("week"))
SQL["parse_week"] = f"""WITH {OUTLETS}, l AS (SELECT outlet_id, list_filter([outlet_id % 9, 1, 3, outlet_id % 7 + 1], lambda d: d BETWEEN 1 AND 7) AS d,
  outlet_id % 10 AS n FROM outlets)
SELECT outlet_id, CASE WHEN outlet_id % 2 = 0 THEN array_to_string(list_filter(d, lambda x, i: list_position(d, x) = i), ',')
  ELSE array_to_string(range(1, least(7, greatest(1, CASE WHEN n = 0 THEN 5 ELSE n END)) + 1), ',') END AS week FROM l"""


def _pins(spark, sf):
    k = c("outlet_id")
    return td.outlets(spark, sf).select(k, F.when(k % 5 == 0, "{bad").otherwise(F.format_string(
        '{"repId": "%d", "week": %d, "dayOfWeek": %d}', c("rep_id"), k % 4 + 1, k % 5 + 1)).alias("pin"))


QUERIES["parse_pin"] = lambda spark, sf: _pins(spark, sf).select("outlet_id", status.parse_pin(c("pin")).alias("p")).select("outlet_id", "p.*")
SQL["parse_pin"] = f"""WITH {OUTLETS} SELECT outlet_id, CASE WHEN outlet_id % 5 <> 0 THEN rep_id END AS rep_id,
  CASE WHEN outlet_id % 5 <> 0 THEN outlet_id % 4 + 1 END AS week, CASE WHEN outlet_id % 5 <> 0 THEN outlet_id % 5 + 1 END AS day_of_week FROM outlets"""

# ------------------------------------------------------------------ status and edits
_ids = lambda spark, sf, cond: td.outlets(spark, sf).filter(cond).select("outlet_id")

QUERIES["exclude_outlets"] = lambda spark, sf: status.exclude_outlets(
    td.outlets(spark, sf), td.edits(spark, sf).filter("kind = 'exclude'")).select("outlet_id", "market_id")
SQL["exclude_outlets"] = f"""WITH {OUTLETS}, {EDITS} SELECT outlet_id, market_id FROM outlets WHERE NOT excluded
  AND outlet_id NOT IN (SELECT outlet_id FROM edits WHERE kind = 'exclude')"""


def _carried(spark, sf):
    o = td.outlets(spark, sf)
    held = o.filter("outlet_id % 101 = 0 or outlet_id % 50 = 0")
    new = o.withColumn("outlet_id", c("outlet_id") + 1000000)
    return status.carry_over_exclusions(new, held).select("outlet_id", "carried")


QUERIES["carry_over_exclusions"] = _carried
SQL["carry_over_exclusions"] = f"""WITH {OUTLETS}, k AS (SELECT outlet_id, coalesce('c|' || code, 's|' || lower(trim(name)) || '|' || lat_e6 // 10 || '|' || lng_e6 // 10) AS key FROM outlets),
h AS (SELECT key, count(*) AS held FROM k WHERE outlet_id % 101 = 0 OR outlet_id % 50 = 0 GROUP BY key),
n AS (SELECT outlet_id, key, row_number() OVER (PARTITION BY key ORDER BY outlet_id) AS rn FROM k)
SELECT outlet_id + 1000000 AS outlet_id, coalesce(rn <= held, false) AS carried FROM n LEFT JOIN h USING (key)"""

QUERIES["restore_excluded"] = lambda spark, sf: status.restore_excluded(
    td.outlets(spark, sf), td.edits(spark, sf).filter("kind = 'restore'")).select("outlet_id", "excluded", "restored")
SQL["restore_excluded"] = f"""WITH {OUTLETS}, {EDITS}, r AS (SELECT *, excluded AND outlet_id IN (SELECT outlet_id FROM edits WHERE kind = 'restore') AS restored FROM outlets)
SELECT outlet_id, excluded AND NOT restored AS excluded, restored FROM r"""


def _status(spark, sf):
    planned = td.stops(spark, sf).select("outlet_id").distinct().withColumn("p", F.lit(True))
    o = td.outlets(spark, sf).join(planned, "outlet_id", "left")
    return o.select("outlet_id", status.outlet_status(c("excluded"), c("offset"), F.coalesce("p", F.lit(False))).alias("status"),
                    status.outlet_status(c("excluded"), c("offset")).alias("universe_status"))


QUERIES["outlet_status"] = _status
SQL["outlet_status"] = f"""WITH {STOPS} SELECT outlet_id, CASE WHEN excluded THEN 'Excluded' WHEN "offset" THEN 'Held for review'
  WHEN outlet_id IN (SELECT outlet_id FROM stops) THEN 'Planned' ELSE 'Not planned' END AS status,
  CASE WHEN excluded THEN 'Excluded' WHEN "offset" THEN 'Held for review' ELSE 'Active' END AS universe_status FROM outlets"""

QUERIES["refresh_geo_flags"] = lambda spark, sf: status.refresh_geo_flags(
    td.outlets(spark, sf).withColumn("offset", c("outlet_id") % 89 == 5),
    td.outlets(spark, sf).filter("latitude > 40")).select("outlet_id", "offset", "flag_change")
SQL["refresh_geo_flags"] = f"""WITH {OUTLETS} SELECT outlet_id, latitude > 40 AS "offset",
  CASE WHEN latitude > 40 AND outlet_id % 89 <> 5 THEN 'flagged' WHEN latitude <= 40 AND outlet_id % 89 = 5 THEN 'cleared' ELSE 'same' END AS flag_change FROM outlets"""

QUERIES["apply_edits"] = lambda spark, sf: status.apply_edits(td.outlets(spark, sf), td.edits(spark, sf)).select(
    "outlet_id", "rep_id", "excluded", "edited")
LAST = """last AS (SELECT outlet_id, kind, to_rep_id FROM edits QUALIFY row_number() OVER (PARTITION BY outlet_id ORDER BY ts DESC, edit_id DESC) = 1)"""
SQL["apply_edits"] = f"""WITH {OUTLETS}, {EDITS}, {LAST} SELECT o.outlet_id, CASE WHEN kind = 'move' THEN to_rep_id ELSE rep_id END AS rep_id,
  CASE WHEN kind = 'exclude' THEN true WHEN kind = 'restore' THEN false ELSE excluded END AS excluded, kind IS NOT NULL AS edited
FROM outlets o LEFT JOIN last USING (outlet_id) WHERE kind IS NULL OR kind <> 'delete'"""

QUERIES["edit_counts"] = lambda spark, sf: status.edit_counts(td.outlets(spark, sf), td.edits(spark, sf), ["market_id"])
SQL["edit_counts"] = f"""WITH {OUTLETS}, {EDITS}, {LAST}, n AS (SELECT outlet_id, count(*) AS n FROM edits GROUP BY 1)
SELECT market_id, count(*) AS before, count(*) FILTER (kind = 'delete') AS deleted, count(*) FILTER (kind = 'move') AS moved,
  count(*) FILTER (kind IS NULL OR kind <> 'delete') AS after, CAST(coalesce(sum(n), 0) AS BIGINT) AS unsaved_edits
FROM outlets LEFT JOIN last USING (outlet_id) LEFT JOIN n USING (outlet_id) GROUP BY market_id"""

QUERIES["edited_cells"] = lambda spark, sf: status.edited_cells(td.stops(spark, sf), td.edits(spark, sf))
SQL["edited_cells"] = f"""WITH {STOPS}, {EDITS}, {LAST}, m AS (SELECT s.*, kind = 'delete' AS gone FROM stops s LEFT JOIN last USING (outlet_id)),
t AS (SELECT rep_id, week, day_of_week, coalesce(bool_or(gone), false) AS v FROM m GROUP BY ALL)
SELECT rep_id, week, day_of_week, outlet_id, CAST(row_number() OVER (PARTITION BY rep_id, week, day_of_week ORDER BY seq) AS INTEGER) AS seq, v AS distance_void
FROM m JOIN t USING (rep_id, week, day_of_week) WHERE gone IS NULL OR NOT gone"""

QUERIES["likely_duplicates_count"] = lambda spark, sf: (
    td.outlets(spark, sf).groupBy("market_id", text.spot_key(c("name"), c("latitude"), c("longitude")).alias("k"))
    .agg(F.count(F.lit(1)).alias("n")).groupBy("market_id").agg(F.sum(c("n") - 1).alias("duplicates")))
SQL["likely_duplicates_count"] = f"""WITH {OUTLETS}, k AS (SELECT market_id, lower(trim(name)) AS nm, lat_e6 // 10 AS a, lng_e6 // 10 AS b, count(*) AS n
  FROM outlets GROUP BY ALL) SELECT market_id, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM k GROUP BY market_id"""
