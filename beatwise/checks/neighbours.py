"""Neighbour operators and their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from beatwise.checks.ingest import NORM
from beatwise.checks.sql import EDITS, OUTLETS, STOPS, hav
from beatwise.functions.numbers import six
from beatwise.operators import neighbours as nb
from beatwise.operators import spots as sp
from beatwise.operators import status
from beatwise.sources import testdata as td

QUERIES, SQL = {}, {}
MARKET = ["market_id"]


def _here(spark, sf):
    return td.outlets(spark, sf).filter("not excluded")


QUERIES["within_km_join"] = lambda spark, sf: nb.within_km_join(_here(spark, sf), MARKET, 0.15).withColumn("km", six(F.col("km")))
SQL["within_km_join"] = f"""WITH {OUTLETS}, s AS (
  SELECT market_id, latitude, longitude, min(outlet_id) AS spot_id, count(*) AS n FROM outlets WHERE NOT excluded GROUP BY ALL)
SELECT a.market_id, a.spot_id AS spot_a, b.spot_id AS spot_b, a.n AS outlets_a, b.n AS outlets_b,
  round({hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}, 6) AS km
FROM s a JOIN s b ON a.market_id = b.market_id AND a.spot_id < b.spot_id AND abs(a.latitude - b.latitude) < 0.01
WHERE {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 0.15"""

QUERIES["kth_neighbour_km"] = lambda spark, sf: nb.kth_neighbour_km(_here(spark, sf), MARKET, 2).withColumn("km", six(F.col("km")))
SQL["kth_neighbour_km"] = f"""WITH {OUTLETS}, o AS (SELECT * FROM outlets WHERE NOT excluded), r AS (
  SELECT a.market_id, a.outlet_id, {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS km
  FROM o a JOIN o b ON a.market_id = b.market_id AND a.outlet_id <> b.outlet_id
  QUALIFY row_number() OVER (PARTITION BY a.outlet_id ORDER BY km, b.outlet_id) = 2)
SELECT o.market_id, o.outlet_id, round(coalesce(r.km, 0.0), 6) AS km FROM o LEFT JOIN r USING (outlet_id)"""

QUERIES["connected_components"] = lambda spark, sf: nb.components(_here(spark, sf), MARKET, 1.0)
SQL["connected_components"] = f"""WITH RECURSIVE {OUTLETS}, o AS (SELECT * FROM outlets WHERE NOT excluded),
e AS (SELECT a.outlet_id AS src, b.outlet_id AS dst FROM o a JOIN o b ON a.market_id = b.market_id
  AND abs(a.latitude - b.latitude) < 0.02 AND {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 1.0),
walk(src, label) AS (SELECT outlet_id, outlet_id FROM o UNION SELECT e.dst, walk.label FROM walk JOIN e ON e.src = walk.src
  WHERE walk.label < e.dst)
SELECT o.market_id, o.outlet_id, min(walk.label) AS component FROM o JOIN walk ON walk.src = o.outlet_id GROUP BY ALL"""

# ------------------------------------------------------------------ groups
HAB = hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')
c = F.col
stops = td.stops


def rounded(df, *names):
    for n in names:
        df = df.withColumn(n, six(c(n)))
    return df


active = lambda spark, sf: td.outlets(spark, sf).filter("not excluded and not offset")
ACT = 'act AS (SELECT * FROM outlets WHERE NOT excluded AND NOT "offset")'

QUERIES["nearest_group_join"] = lambda spark, sf: rounded(nb.nearest(active(spark, sf), active(spark, sf), MARKET, 1, carry=("rep_id",), differing="rep_id"), "km").select("outlet_id", "nbr_id", "nbr_rep_id", "km")
SQL["nearest_group_join"] = f"""WITH {OUTLETS}, {ACT} SELECT a.outlet_id, b.outlet_id AS nbr_id, b.rep_id AS nbr_rep_id, round({HAB}, 6) AS km FROM act a JOIN act b ON a.market_id = b.market_id AND a.rep_id <> b.rep_id
QUALIFY row_number() OVER (PARTITION BY a.outlet_id ORDER BY {HAB}, b.outlet_id) = 1"""

QUERIES["group_gap_km"] = lambda spark, sf: rounded(sp.group_gap_km(active(spark, sf), MARKET, "rep_id", 3.0), "gap_km", "box_gap_km")
SQL["group_gap_km"] = f"""WITH {OUTLETS}, {ACT}, g AS (SELECT a.market_id, a.rep_id AS a, b.rep_id AS b, min({HAB}) AS gap_km FROM act a JOIN act b ON a.market_id = b.market_id AND a.rep_id < b.rep_id GROUP BY ALL),
x AS (SELECT rep_id, min(latitude) AS p, max(latitude) AS q, min(longitude) AS r, max(longitude) AS s FROM act GROUP BY 1)
SELECT market_id, a, b, round(gap_km, 6) AS gap_km, round(sqrt(power(greatest(0, m.p - n.q, n.p - m.q) * 110.57, 2) + power(greatest(0, m.r - n.s, n.r - m.s) * 111.32 * cos(radians((m.p + m.q + n.p + n.q) / 4)), 2)), 6) AS box_gap_km
FROM g JOIN x m ON m.rep_id = a JOIN x n ON n.rep_id = b WHERE gap_km <= 3"""

QUERIES["geo_outliers"] = lambda spark, sf: sp.geo_outliers(td.outlets(spark, sf), MARKET)
SQL["geo_outliers"] = f"""WITH RECURSIVE {OUTLETS}, e AS (SELECT a.outlet_id AS src, b.outlet_id AS dst, {HAB} AS km FROM outlets a JOIN outlets b ON a.market_id = b.market_id AND abs(a.latitude - b.latitude) < 0.3 AND {HAB} <= 30),
e5 AS (SELECT DISTINCT src, dst FROM e WHERE km <= 5), w5(src, label) AS (SELECT outlet_id, outlet_id FROM outlets UNION SELECT e5.dst, w5.label FROM w5 JOIN e5 ON e5.src = w5.src WHERE w5.label < e5.dst),
c5 AS (SELECT o.market_id, o.outlet_id, min(label) AS comp FROM w5 JOIN outlets o ON o.outlet_id = w5.src GROUP BY ALL),
cs AS (SELECT market_id, comp, count(*) AS n FROM c5 GROUP BY 1, 2), ct AS (SELECT *, sum(n) OVER (PARTITION BY market_id) AS tot FROM cs), main AS (SELECT market_id, comp, n >= greatest(10, floor(tot * 0.01)) AS is_main, tot FROM ct),
ce AS (SELECT DISTINCT x.comp AS a, y.comp AS b FROM e JOIN c5 x ON x.outlet_id = e.src JOIN c5 y ON y.outlet_id = e.dst JOIN main mx ON mx.comp = x.comp JOIN main my ON my.comp = y.comp WHERE NOT (mx.is_main AND my.is_main)),
wk(a, root) AS (SELECT comp, comp FROM main WHERE is_main UNION SELECT ce.b, wk.root FROM wk JOIN ce ON ce.a = wk.a),
fl AS (SELECT c5.market_id, c5.comp, o.outlet_id, o.latitude, o.longitude FROM c5 JOIN outlets o USING (outlet_id) JOIN main m ON m.comp = c5.comp WHERE NOT m.is_main AND m.tot >= 10 AND c5.comp NOT IN (SELECT a FROM wk)),
gp AS (SELECT a.comp, min({HAB}) AS gap FROM fl a JOIN c5 x ON x.market_id = a.market_id JOIN main m ON m.comp = x.comp AND m.is_main JOIN outlets b ON b.outlet_id = x.outlet_id GROUP BY 1)
SELECT market_id, outlet_id, floor(gap * 10 + 0.5) / 10 AS gap_km FROM fl JOIN gp USING (comp)"""

QUERIES["duplicate_links"] = lambda spark, sf: sp.duplicate_links(_here(spark, sf), MARKET, 120.0, 400.0)
SQL["duplicate_links"] = f"""WITH {OUTLETS}, n AS (SELECT market_id, outlet_id, latitude, longitude, {NORM('name')} AS k, min(outlet_id) OVER (PARTITION BY market_id, latitude, longitude) AS spot FROM outlets WHERE NOT excluded)
SELECT DISTINCT a.market_id, a.spot AS src, b.spot AS dst FROM n a JOIN n b ON a.market_id = b.market_id AND a.spot < b.spot AND abs(a.latitude - b.latitude) < 0.01
WHERE {HAB} <= 0.12 OR (a.k = b.k AND length(a.k) >= 2 AND {HAB} <= 0.4)"""

QUERIES["duplicate_clusters"] = lambda spark, sf: sp.duplicate_clusters(_here(spark, sf), MARKET, 60.0)

QUERIES["misfit_outlets"] = lambda spark, sf: rounded(sp.misfit_outlets(active(spark, sf), MARKET), "own_km", "other_km", "savings_km")
MISFIT = f"""ow AS (SELECT a.outlet_id, {HAB} AS km, row_number() OVER (PARTITION BY a.outlet_id ORDER BY km, b.outlet_id) AS r FROM act a JOIN act b ON a.rep_id = b.rep_id AND a.outlet_id <> b.outlet_id),
own AS (SELECT outlet_id, max(km) AS own_km FROM ow WHERE r <= 3 GROUP BY 1),
ot AS (SELECT a.outlet_id, b.rep_id AS suggested, {HAB} AS other_km FROM act a JOIN act b ON a.market_id = b.market_id AND a.rep_id <> b.rep_id QUALIFY row_number() OVER (PARTITION BY a.outlet_id ORDER BY {HAB}, b.rep_id) = 1),
mis AS (SELECT market_id, outlet_id, rep_id AS current, own_km, suggested, other_km, own_km - other_km AS savings_km FROM act JOIN own USING (outlet_id) JOIN ot USING (outlet_id) WHERE other_km < own_km * 0.5 AND own_km - other_km > 1 AND other_km <= 11)"""
SQL["misfit_outlets"] = f"WITH {OUTLETS}, {ACT}, {MISFIT} SELECT market_id, outlet_id, current, round(own_km, 6) AS own_km, suggested, round(other_km, 6) AS other_km, round(savings_km, 6) AS savings_km FROM mis"
QUERIES["top_misfits"] = lambda spark, sf: sp.top_of_all(rounded(sp.misfit_outlets(active(spark, sf), MARKET), "savings_km"), MARKET, [F.desc("savings_km"), c("outlet_id")]).select("market_id", "outlet_id", "savings_km", "place", "total")
SQL["top_misfits"] = f"""WITH {OUTLETS}, {ACT}, {MISFIT} SELECT market_id, outlet_id, round(savings_km, 6) AS savings_km, CAST(row_number() OVER (PARTITION BY market_id ORDER BY round(savings_km, 6) DESC, outlet_id) AS INTEGER) AS place, count(*) OVER (PARTITION BY market_id) AS total FROM mis QUALIFY place <= 100"""

QUERIES["stray_vote"] = lambda spark, sf: sp.stray_votes(nb.nearest(active(spark, sf), active(spark, sf), MARKET, 8).select("market_id", "outlet_id", "nbr_id"), active(spark, sf), MARKET, "rep_id")
STRAY = f"""kn AS (SELECT a.market_id, a.outlet_id, a.rep_id AS own, b.rep_id AS g FROM act a JOIN act b ON a.market_id = b.market_id AND a.outlet_id <> b.outlet_id QUALIFY row_number() OVER (PARTITION BY a.outlet_id ORDER BY {HAB}, b.outlet_id) <= 8),
v AS (SELECT market_id, outlet_id, own, g, count(*) AS v FROM kn GROUP BY ALL), m AS (SELECT *, coalesce(max(v) FILTER (g = own) OVER (PARTITION BY outlet_id), 0) AS mine FROM v),
strays AS (SELECT market_id, outlet_id, own AS from_group, g AS to_group, v - mine AS margin FROM m WHERE g <> own AND v * 2 > 8 AND v > mine QUALIFY row_number() OVER (PARTITION BY outlet_id ORDER BY v DESC, g) = 1)"""
SQL["stray_vote"] = f"WITH {OUTLETS}, {ACT}, {STRAY} SELECT * FROM strays"

QUERIES["dbscan"] = lambda spark, sf: sp.dbscan(active(spark, sf), MARKET, 0.6, 5)
SQL["dbscan"] = f"""WITH RECURSIVE {OUTLETS}, {ACT}, e AS (SELECT a.market_id, a.outlet_id AS src, b.outlet_id AS dst, {HAB} AS km FROM act a JOIN act b ON a.market_id = b.market_id AND abs(a.latitude - b.latitude) < 0.01 AND {HAB} <= 0.6),
core AS (SELECT src AS id FROM e GROUP BY src HAVING count(*) >= 5), ce AS (SELECT src, dst FROM e WHERE src IN (FROM core) AND dst IN (FROM core)),
walk(src, label) AS (SELECT id, id FROM core UNION SELECT ce.dst, walk.label FROM walk JOIN ce ON ce.src = walk.src WHERE walk.label < ce.dst), lab AS (SELECT src AS id, min(label) AS l FROM walk GROUP BY 1),
rim AS (SELECT e.src AS id, lab.l FROM e JOIN lab ON lab.id = e.dst WHERE e.src NOT IN (FROM core) QUALIFY row_number() OVER (PARTITION BY e.src ORDER BY km, e.dst) = 1)
SELECT market_id, outlet_id, coalesce(lab.l, rim.l) AS cluster FROM act LEFT JOIN lab ON lab.id = outlet_id LEFT JOIN rim ON rim.id = outlet_id"""

QUERIES["density_clusters"] = lambda spark, sf: sp.density_clusters(active(spark, sf), MARKET, 3, 0.6)
SQL["density_clusters"] = f"""WITH RECURSIVE {OUTLETS}, {ACT}, e AS (SELECT a.market_id, a.outlet_id AS src, b.outlet_id AS dst FROM act a JOIN act b ON a.market_id = b.market_id AND a.outlet_id <> b.outlet_id AND abs(a.latitude - b.latitude) < 0.01 AND {HAB} <= 0.6),
core AS (SELECT src AS id FROM e GROUP BY src HAVING count(*) >= 3), ce AS (SELECT src, dst FROM e WHERE src IN (FROM core) AND dst IN (FROM core)),
walk(src, label) AS (SELECT id, id FROM core UNION SELECT ce.dst, walk.label FROM walk JOIN ce ON ce.src = walk.src WHERE walk.label < ce.dst), lab AS (SELECT src AS id, min(label) AS l FROM walk GROUP BY 1)
SELECT market_id, outlet_id, coalesce(lab.l, outlet_id) AS cluster FROM act LEFT JOIN lab ON lab.id = outlet_id"""

QUERIES["village_blocks"] = lambda spark, sf: sp.village_blocks(_here(spark, sf), MARKET, 0.5, "vf", 40).select("market_id", "outlet_id", "unit", "blocked")
SQL["village_blocks"] = f"""WITH RECURSIVE {OUTLETS}, o AS (SELECT * FROM outlets WHERE NOT excluded), e AS (SELECT a.outlet_id AS src, b.outlet_id AS dst FROM o a JOIN o b ON a.market_id = b.market_id AND abs(a.latitude - b.latitude) < 0.01 AND {HAB} <= 0.5),
walk(src, label) AS (SELECT outlet_id, outlet_id FROM o UNION SELECT e.dst, walk.label FROM walk JOIN e ON e.src = walk.src WHERE walk.label < e.dst), lab AS (SELECT src AS outlet_id, min(label) AS l FROM walk GROUP BY 1),
s AS (SELECT l, count(*) > 1 AND sum(vf) <= 40 AND NOT bool_or("offset") AS ok FROM lab JOIN o USING (outlet_id) GROUP BY 1)
SELECT market_id, outlet_id, CASE WHEN ok THEN l ELSE outlet_id END AS unit, ok AS blocked FROM o JOIN lab USING (outlet_id) JOIN s USING (l)"""

QUERIES["footprint_cells"] = lambda spark, sf: sp.footprint_cells(active(spark, sf), ["rep_id"])
SQL["footprint_cells"] = f"""WITH RECURSIVE {OUTLETS}, {ACT}, own AS (SELECT DISTINCT rep_id, CAST(floor(latitude / 0.01::DOUBLE) AS BIGINT) AS y, CAST(floor(longitude / 0.01::DOUBLE) AS BIGINT) AS x FROM act),
grown AS (SELECT DISTINCT rep_id, y + dy AS y, x + dx AS x FROM own, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)), n AS (SELECT rep_id, y, x, y * 10000000 + x AS id FROM grown),
e AS (SELECT a.rep_id, a.id AS src, b.id AS dst FROM n a JOIN n b ON a.rep_id = b.rep_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
walk(rep_id, src, label) AS (SELECT rep_id, id, id FROM n UNION SELECT e.rep_id, e.dst, w.label FROM walk w JOIN e ON e.rep_id = w.rep_id AND e.src = w.src WHERE w.label < e.dst), lab AS (SELECT rep_id, src AS id, min(label) AS piece FROM walk GROUP BY ALL)
SELECT n.rep_id, y AS cell_y, x AS cell_x, piece, count(*) OVER (PARTITION BY n.rep_id, piece) AS piece_cells FROM n JOIN lab ON lab.rep_id = n.rep_id AND lab.id = n.id"""


# ------------------------------------------------------------------ plan against ownership
def _edited_owner(spark, sf):
    return status.apply_edits(td.outlets(spark, sf), td.edits(spark, sf)).filter("not excluded and not offset")


OWNED = f"""{STOPS}, {EDITS}, last AS (SELECT outlet_id, kind, to_rep_id FROM edits QUALIFY row_number() OVER (PARTITION BY outlet_id ORDER BY ts DESC, edit_id DESC) = 1),
owned AS (SELECT outlet_id, CASE WHEN kind = 'move' THEN to_rep_id ELSE rep_id END AS rep_id FROM outlets LEFT JOIN last USING (outlet_id)
  WHERE (kind IS NULL OR kind <> 'delete') AND NOT "offset" AND NOT CASE WHEN kind = 'exclude' THEN true WHEN kind = 'restore' THEN false ELSE excluded END)"""
QUERIES["stale_missing_diff"] = lambda spark, sf: sp.stale_missing(_edited_owner(spark, sf), stops(spark, sf))
SQL["stale_missing_diff"] = f"""WITH {OWNED}, s AS (SELECT DISTINCT rep_id, outlet_id FROM stops), a AS (SELECT rep_id, count(*) AS stale FROM (FROM s EXCEPT SELECT rep_id, outlet_id FROM owned) GROUP BY 1),
b AS (SELECT rep_id, count(*) AS missing FROM (SELECT rep_id, outlet_id FROM owned EXCEPT FROM s) GROUP BY 1)
SELECT rep_id, coalesce(stale, 0) AS stale, coalesce(missing, 0) AS missing, 'regroup' AS action FROM a FULL JOIN b USING (rep_id)"""

QUERIES["affected_reps"] = lambda spark, sf: sp.affected_reps(td.edits(spark, sf), td.outlets(spark, sf), stops(spark, sf))
SQL["affected_reps"] = f"""WITH {STOPS}, {EDITS}, i AS (SELECT DISTINCT outlet_id FROM edits)
SELECT DISTINCT rep_id FROM outlets WHERE outlet_id IN (FROM i) UNION SELECT rep_id FROM stops WHERE outlet_id IN (FROM i)"""

_capacity = lambda spark, sf: td.reps(spark, sf).select("rep_id", (110 + c("rep_id") % 40).alias("capacity"))
QUERIES["nearest_receiver"] = lambda spark, sf: rounded(sp.nearest_receiver(active(spark, sf), _capacity(spark, sf), MARKET), "km")
SQL["nearest_receiver"] = f"""WITH {OUTLETS}, {ACT}, st AS (SELECT market_id, rep_id, sum(vf) - (110 + rep_id % 40) AS ex, avg(latitude) AS la, avg(longitude) AS lo FROM act GROUP BY market_id, rep_id),
cd AS (SELECT o.market_id, o.outlet_id, o.rep_id, o.vf, s.ex, r.rep_id AS to_rep, {hav('o.latitude', 'o.longitude', 'r.la', 'r.lo')} AS km FROM act o JOIN st s ON s.rep_id = o.rep_id AND s.ex > 0 JOIN st r ON r.market_id = o.market_id AND r.ex < 0
  QUALIFY row_number() OVER (PARTITION BY o.outlet_id ORDER BY {hav('o.latitude', 'o.longitude', 'r.la', 'r.lo')}, r.rep_id) = 1),
cu AS (SELECT *, coalesce(sum(vf) OVER (PARTITION BY rep_id ORDER BY km, outlet_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM cd)
SELECT market_id, outlet_id, rep_id AS from_rep_id, to_rep AS to_rep_id, vf, round(km, 6) AS km FROM cu WHERE b < ex QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY rep_id, cu.km, outlet_id) <= 30"""

QUERIES["mirror_cells"] = lambda spark, sf: sp.mirror_cells(stops(spark, sf), stops(spark, sf).filter("week = 1"))
SQL["mirror_cells"] = f"""WITH {STOPS}, n AS (SELECT rep_id, week, day_of_week, count(*) AS n FROM stops GROUP BY ALL),
h AS (SELECT b.rep_id, b.day_of_week, a.week AS target_week, b.week, count(*) AS shared FROM stops a JOIN stops b ON a.rep_id = b.rep_id AND a.day_of_week = b.day_of_week AND a.outlet_id = b.outlet_id WHERE a.week = 1 GROUP BY ALL)
SELECT h.* FROM h JOIN n x USING (rep_id, day_of_week, week) JOIN n y ON y.rep_id = h.rep_id AND y.day_of_week = h.day_of_week AND y.week = h.target_week WHERE shared >= greatest(1, ceil(0.4 * least(x.n, y.n))) OR h.week = h.target_week"""
