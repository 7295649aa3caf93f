"""Plan tables, scenarios, exports and streams end to end."""
import json

from pyspark.sql import functions as F

from beatwise.operators import scenarios as sc
from beatwise.params import Band, PlanSettings
from beatwise.sources import exports, tables
from beatwise.sources import testdata as td
from beatwise.streaming import edits as se
from beatwise.streaming import uploads as su

SF = "/root/testdata/sf0.001"


def test_tables_replace_only_their_partitions(spark, tmp_path):
    o = td.outlets(spark, SF)
    tables.write_table(o, str(tmp_path), "outlets")
    tables.write_table(o.filter("market_id = 1").withColumn("vf", F.lit(9)), str(tmp_path), "outlets")
    back = tables.read_table(spark, str(tmp_path), "outlets")
    assert back.count() == o.count()
    assert back.filter("vf = 9").count() == o.filter("market_id = 1").count()


def test_scenario_capture_and_apply(spark, tmp_path):
    o = td.outlets(spark, SF)
    sc.capture({"outlets": o, "stops": td.stops(spark, SF)}, str(tmp_path), "s1")
    changed = o.withColumn("rep_id", F.lit(-1).cast("long")).withColumn("excluded", F.lit(False))
    snap = spark.read.parquet(f"{tmp_path}/outlets").filter("scenario_id = 's1'")
    back = sc.apply_scenario(changed, snap)
    assert back.filter("rep_id = -1").count() == 0
    assert back.filter("excluded").count() == o.filter("excluded").count()


def test_exports_land_as_csv(spark, tmp_path):
    exports.write(exports.cluster_export(td.outlets(spark, SF).withColumn("zone_id", F.col("rep_id") % 3)), str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/outlets").count() == td.outlets(spark, SF).count()


def _edit_files(folder, spark):
    ids = [r.outlet_id for r in td.memberships(spark, SF).orderBy("outlet_id").limit(3).collect()]
    folder.mkdir()
    rows = [{"edit_id": 1, "ts": "2026-01-01T00:00:00Z", "kind": "delete", "outlet_id": ids[0], "to_rep_id": None},
            {"edit_id": 2, "ts": "2026-01-01T00:01:00Z", "kind": "move", "outlet_id": ids[1], "to_rep_id": 3}]
    (folder / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    return ids


def test_edit_stream_names_reps(spark, tmp_path):
    ids = _edit_files(tmp_path / "in", spark)
    q = se.track_affected(se.read_edits(spark, str(tmp_path / "in")), td.outlets(spark, SF), td.stops(spark, SF), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = {r.rep_id for r in spark.read.parquet(str(tmp_path / "out/affected")).collect()}
    assert got == {r.rep_id for r in td.outlets(spark, SF).filter(F.col("outlet_id").isin(ids[:2])).collect()}


def _plan(spark, folder):
    tables.start_plan(td.outlets(spark, SF), td.stops(spark, SF), folder)
    return lambda name: tables.read_version(spark, folder, name, tables.manifest(spark, folder))


def _edits(spark, rows):
    return spark.createDataFrame([(i, "2026-01-01 00:00:00", *r) for i, r in enumerate(rows)], "edit_id bigint, ts string, kind string, outlet_id bigint, to_rep_id bigint, week int, day_of_week int").withColumn(
        "ts", F.to_timestamp("ts"))


LOOSE = PlanSettings(band=Band(0, 60))


def test_edit_stream_replans_touched_reps(spark, tmp_path):
    plan = str(tmp_path / "plan")
    now = _plan(spark, plan)
    ids = _edit_files(tmp_path / "in", spark)
    q = se.replan_on_edits(se.read_edits(spark, str(tmp_path / "in")), plan, LOOSE, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    outlets, stops = now("outlets"), now("stops")
    assert outlets.filter(F.col("outlet_id") == ids[0]).count() == 0 and outlets.count() == td.outlets(spark, SF).count() - 1
    assert stops.filter(F.col("outlet_id") == ids[0]).count() == 0
    moved = stops.filter(F.col("outlet_id") == ids[1]).select("rep_id").distinct().collect()
    assert [r.rep_id for r in moved] == [3]
    before = td.stops(spark, SF)
    assert stops.filter(F.col("outlet_id") == ids[2]).count() == before.filter(F.col("outlet_id") == ids[2]).count()
    counts = spark.read.parquet(str(tmp_path / "out/counts")).agg(F.sum("before").alias("b"), F.sum("after").alias("a")).first()
    assert counts.b - counts.a == 1


def test_edits_that_empty_a_rep_and_a_market(spark, tmp_path):
    plan, out = str(tmp_path / "plan"), str(tmp_path / "out")
    now = _plan(spark, plan)
    o = td.outlets(spark, SF)
    rep = td.stops(spark, SF).filter("market_id <> 2").first().rep_id
    lost = o.filter((F.col("rep_id") == rep) | (F.col("market_id") == 2)).collect()
    batch = _edits(spark, [("delete", r.outlet_id, None, None, None) for r in lost])
    se.apply_batch(batch, 0, plan, LOOSE, out)
    state = lambda: {n: sorted(tuple(r) for r in now(n).select(*cols).collect()) for n, cols in (("outlets", ["outlet_id", "rep_id"]), ("stops", ["rep_id", "week", "day_of_week", "seq", "outlet_id"]))}
    first = state()
    gone = {r.outlet_id for r in lost}
    assert not gone & {r[0] for r in first["outlets"]} and not gone & {r[4] for r in first["stops"]} and rep not in {r[0] for r in first["stops"]}
    assert len(first["outlets"]) == o.count() - len(gone)
    others = {tuple(r) for r in td.stops(spark, SF).filter((F.col("market_id") != 2) & (F.col("rep_id") != rep)).select("rep_id", "week", "day_of_week", "seq", "outlet_id").collect()}
    assert others <= set(first["stops"])
    # The same batch again, as after a failure, changes nothing; what it read was the plan before it.
    se.apply_batch(batch, 0, plan, LOOSE, out)
    assert state() == first
    # A manifest that isn't whole doesn't count.
    half = tables.manifest(spark, plan).limit(1).withColumn("entries", F.lit(99).cast("bigint"))
    half.write.parquet(f"{plan}/manifest/made=7")
    assert state() == first


def test_pins_hold_through_the_stream(spark, tmp_path):
    plan, out = str(tmp_path / "plan"), str(tmp_path / "out")
    now = _plan(spark, plan)
    s = td.stops(spark, SF).filter("vf = 4").orderBy("outlet_id").first()
    cell = now("stops").filter((F.col("rep_id") == s.rep_id) & (F.col("day_of_week") != s.day_of_week)).orderBy("week", "day_of_week").first()
    se.apply_batch(_edits(spark, [("pin", s.outlet_id, None, cell.week, cell.day_of_week)]), 0, plan, LOOSE, out)
    held = lambda: now("stops").filter((F.col("outlet_id") == s.outlet_id) & (F.col("week") == cell.week) & (F.col("day_of_week") == cell.day_of_week)).count()
    assert held() == 1 and now("pins").count() == 1 and now("stops").filter(F.col("outlet_id") == s.outlet_id).count() == 4
    other = now("stops").filter((F.col("rep_id") == s.rep_id) & (F.col("outlet_id") != s.outlet_id)).orderBy("outlet_id").first().outlet_id
    se.apply_batch(_edits(spark, [("delete", other, None, None, None)]), 1, plan, LOOSE, out)
    assert held() == 1 and now("stops").filter(F.col("outlet_id") == other).count() == 0


def test_upload_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [f"Shop {i},C{i},{33.5 + 0.001 * (i % 10)},{35.5 + 0.001 * (i // 10)},{i % 5}" for i in range(40)] + ["Rome,R1,41.9,12.5,1", ",,33.5,35.5,1", "Bad,B1,abc,35.5,2"]
    (tmp_path / "in/list.csv").write_text("Outlet Name,Client Code,Latitude,Longitude,VF\n" + "\n".join(rows))
    held = spark.createDataFrame([("Shop 3", "C3", 33.503, 35.5)], "name string, code string, latitude double, longitude double")
    s = su.read_uploads(spark, str(tmp_path / "in"), ["Outlet Name", "Client Code", "Latitude", "Longitude", "VF"])
    su.ingest_uploads(s, held, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out/outlets"))
    assert out.count() == 41 and out.filter("excluded").count() == 1
    assert [r.name for r in out.filter("offset").collect()] == ["Rome"]
    assert spark.read.parquet(str(tmp_path / "out/rejected")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out/reports")).first().valid == 41
