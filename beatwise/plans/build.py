"""Whole plans: from a list of outlets to stops of every rep, week and weekday; and partial re-plans."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatwise.functions import cycle
from beatwise.operators import market as mk
from beatwise.operators import partition as pt
from beatwise.operators.route_metrics import CELL, route_legs, scorecard_days, spread_tour
from beatwise.operators.routes import order_stops, sequence_days
from beatwise.operators.schedule import expand_visits
from beatwise.operators.scorecard import month_issues
from beatwise.operators.spots import stale_missing
from beatwise.params import PlanSettings
from beatwise.plans.cuts import best_cut, pieces_and_days
from beatwise.plans.keep_days import REP, day_loads, place_arrivals, read_back_bands, relieve_overloaded_days, restore_band
from beatwise.session import cut

c = F.col
POINT = ["outlet_id", "latitude", "longitude"]


def weights(outlets: DataFrame, keys: list[str], settings: PlanSettings) -> DataFrame:
    """Add ``unit``, what a visit weighs: one, or its working time against the market's mean (balance by time)."""
    if settings.balance != "time":
        return outlets.withColumn("unit", F.lit(1.0))
    w = mk.workload_weights(mk.second_neighbours(outlets, keys), keys, settings.workday)
    return outlets.join(w.select(*keys, "outlet_id", c("weight").alias("unit")), [*keys, "outlet_id"])


def zones(outlets: DataFrame, settings: PlanSettings, keys: list[str] = ["market_id"]) -> DataFrame:
    """Zones of a market about the size of a day-route: keys, outlet_id, zone_id.

    k-means gives as many as the visits need, those wider than the cap are cut, those too small are joined.
    """
    per_week = F.least(F.lit(1.0), F.greatest(F.lit(1.0 / settings.repeats), F.sum("vf") / settings.repeats / F.count(F.lit(1))))
    # Markets differ in how often outlets are visited, so in the outlets of a day; the narrowest and widest bound the joins.
    need = outlets.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), per_week.alias("_share"))
    need = cut(need.withColumn("_k", F.greatest(F.lit(1), F.ceil(c("_n") * c("_share") / settings.band.high)).cast("int")))
    share = need.agg(F.min("_share").alias("s")).first()["s"] or 1.0
    z = cut(pt.kmeans_zones(outlets.join(need.select(*keys, "_k"), keys), keys, c("_k"), 1))
    split = pt.split_oversized_zones(z, keys, settings.zone_km)
    least, most = max(1, round(settings.band.low / share)), max(2, round(settings.band.high / share))
    return pt.merge_undersized_zones(split, keys, least, most, settings.zone_km).select(*keys, "outlet_id", "zone_id")


def territories(outlets: DataFrame, reps: Column, settings: PlanSettings = PlanSettings(), keys: list[str] = ["market_id"]) -> tuple[DataFrame, DataFrame]:
    """Outlets of a market shared among ``reps`` reps by the weight of their visits: keys, outlet_id, weight, below,
    above, group; and the neighbour list.

    Cut along the curve, evened out and made coherent; straight cuts are taken instead where they drive
    no more than 3% further. Pockets inside a neighbour's area then go to that neighbour. The band is what
    the day band leaves around the mean, 2.5% at most.
    """
    o = cut(outlets.select(*keys, *POINT, (c("vf") * c("unit")).cast("double").alias("weight"), reps.cast("int").alias("k")))
    mean = o.groupBy(*keys).agg((F.sum("weight") / F.max("k")).alias("_mean"))
    tight = lambda left: F.least(F.lit(0.025), F.greatest(F.lit(0.005), left / c("_mean")))
    band = mean.select(*keys, tight(c("_mean") - settings.band.low * settings.cycle_days).alias("below"), tight(settings.band.high * settings.cycle_days - c("_mean")).alias("above"))
    o = cut(o.join(band, keys))
    cols = [*keys, "outlet_id", "weight", "below", "above", "group"]
    graph = pt.neighbour_graph(o, keys)
    start = pt.hilbert_partition(o, keys, c("k")).select(*cols)
    if not settings.search:
        return cut(start), graph
    even = pt.repair_loads(start, graph, keys, "below", "above", settings.hop_km)
    tidy = pt.repair_loads(pt.cohesion_moves(even, graph, keys, "below", "above"), graph, keys, "below", "above", settings.hop_km)
    by_line = pt.line_split(o, keys, c("k"), below="below", above="above").withColumnRenamed("part", "group")
    made = cut(tidy.select(*cols, F.lit(0).alias("variant")).unionByName(by_line.select(*cols, F.lit(1).alias("variant"))))
    km = spread_tour(made.join(o.select(*keys, *POINT), [*keys, "outlet_id"]), [*keys, "variant", "group"]).groupBy(*keys, "variant").agg(F.sum("tour_km").alias("km"))
    best = km.groupBy(*keys).agg(F.min(F.struct((c("km") / F.when(c("variant") == 1, 1.03).otherwise(1.0)).alias("km"), -c("variant"), "variant")).alias("b"))
    state = made.join(best.select(*keys, c("b.variant").alias("variant")), [*keys, "variant"]).select(*cols)
    if settings.hop_km > 0:
        state = pt.pocket_exchange(state, o, keys, settings.hop_km, graph, "below", "above")
    return cut(state.select(*cols)), graph


def day_cut(owned: DataFrame, settings: PlanSettings, graph: DataFrame | None = None) -> DataFrame:
    """Day-group of every outlet of every rep (REP, outlet_id, vf, unit, latitude, longitude), with ``core``: whether
    it lies in the rep's largest piece.

    A territory falls into pieces that can be driven within the hop, each piece gets its share of the days and
    is cut by the visits it carries a run; then the days are put in a short driving order. Of a market's neighbour
    list, where there is one, the neighbours in the same piece are used.
    """
    o = cut(owned.select(*REP, *POINT, (F.least(c("vf"), F.lit(settings.repeats)) / settings.repeats * c("unit")).alias("weight")))
    members, pieces = pieces_and_days(o, REP, settings.day_groups, settings.band, settings.hop_km)
    pieces = cut(pieces)
    rank = Window.partitionBy(*REP).orderBy(F.desc("load"), "piece")
    base = F.coalesce(F.sum("days").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumn("_from", base).withColumn("core", F.row_number().over(rank) == 1)
    if graph is not None and settings.search:
        there = members.select("market_id", *[c(x).alias(f"_{x}") for x in ("rep_id", "piece")], c("outlet_id").alias("nbr_id"))
        graph = graph.join(members, ["market_id", "outlet_id"]).join(there, ["market_id", "nbr_id"]).filter("rep_id = _rep_id and piece = _piece").select(
            *REP, "piece", "outlet_id", "nbr_id", "km")
    parts = o.join(members, [*REP, "outlet_id"]).join(pieces.select(*REP, "piece", c("days").alias("k")), [*REP, "piece"])
    cut_up = best_cut(parts, [*REP, "piece"], settings.band, settings.hop_km, 0.75, 4, graph) if settings.search else pt.hilbert_partition(parts, [*REP, "piece"], c("k"))
    days = cut(cut_up.join(pieces.select(*REP, "piece", "_from", "core"), [*REP, "piece"]).select(
        *REP, "outlet_id", (c("_from") + c("group")).cast("int").alias("_g"), "core").join(o, [*REP, "outlet_id"]))
    mid = days.groupBy(*REP, c("_g").alias("day_group")).agg(
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.count(F.lit(1)).alias("outlets"))
    order = sequence_days(mid, REP).select(*REP, c("day_group").alias("_g"), (c("place") - 1).cast("int").alias("day_group"))
    return cut(days.join(order, [*REP, "_g"]).select(*REP, "outlet_id", "day_group", "core"))


def feedback(owned: DataFrame, days: DataFrame, graph: DataFrame, settings: PlanSettings, passes: int = 2) -> tuple[DataFrame, DataFrame]:
    """Outlets and days after the days have corrected the territories: (REP, ...), (REP, outlet_id, day_group, core).

    What the days of a rep's core lack to the floor, or hold over the ceiling, moves over the nearest border; only
    the reps touched are cut again. Two passes, each bounded by what it measures: that is the rule, the
    second closes what the first leaves. Floor and ceiling are a tenth around the mean where the band can't be met.
    """
    cols = owned.columns
    for _ in range(passes):
        at = owned.join(days, [*REP, "outlet_id"]).withColumn("_w", F.least(c("vf"), F.lit(settings.repeats)) / settings.repeats * c("unit"))
        per_market = at.groupBy("market_id").agg((F.sum("_w") / F.count_distinct("rep_id") / settings.day_groups).alias("_mean"))
        low = F.when(c("_mean") < settings.band.low, F.floor(c("_mean") * 0.9)).otherwise(F.lit(settings.band.low))
        high = F.when(c("_mean") < settings.band.low, F.least(F.lit(settings.band.high), F.ceil(c("_mean") * 1.1))).otherwise(F.lit(settings.band.high))
        load = at.filter("core").groupBy(*REP, "day_group").agg(F.sum("_w").alias("load")).join(per_market, "market_id")
        # In the weight of a whole cycle, as the territories are.
        gap = lambda x: (F.sum(F.greatest(F.lit(0.0), x)) * settings.repeats)
        need = cut(load.groupBy(*REP).agg(gap(low - c("load")).alias("short"), gap(c("load") - high).alias("over"), gap(high - c("load")).alias("take"), gap(c("load") - low).alias("give")))
        if need.filter("short > 0 or over > 0").isEmpty():
            break
        need = need.select("market_id", c("rep_id").alias("group"), F.when(c("short") > 0, c("short")).otherwise(-c("over")).alias("need"), "give", "take")
        state = owned.select("market_id", "outlet_id", c("rep_id").alias("group"), (c("vf") * c("unit")).cast("double").alias("weight"))
        moved = pt.territory_feedback(state, graph, need, ["market_id"], settings.hop_km or 4.0)
        to = moved.select("market_id", "outlet_id", c("group").alias("_to"))
        both = cut(owned.join(to, ["market_id", "outlet_id"]))
        touched = cut(both.filter("rep_id <> _to").select("market_id", F.explode(F.array("rep_id", "_to")).alias("rep_id")).distinct())
        if touched.isEmpty():
            break
        owned = cut(both.withColumn("rep_id", c("_to")).select(*cols))
        again = day_cut(owned.join(touched, REP, "left_semi"), settings, graph)
        days = cut(days.join(touched, REP, "left_anti").unionByName(again))
    return owned, days


def week_cut(owned: DataFrame, days: DataFrame, settings: PlanSettings) -> DataFrame:
    """Memberships (REP, outlet_id, day_group, visits, bucket): each frequency of a day-group is cut into the weeks
    it falls on. Where an outlet needs more visits than its day has runs, a second day close by takes the rest."""
    r = F.lit(settings.repeats)
    placed = cut(owned.join(days.select(*REP, "outlet_id", "day_group"), [*REP, "outlet_id"]))
    cols = [*REP, *POINT, "day_group", "visits", "unit"]
    pool = placed.withColumn("visits", F.element_at(cycle.memberships_for(c("vf"), r), 1)).select(*cols)
    if settings.repeats < 4 and not placed.filter(c("vf") > settings.repeats).isEmpty():
        second = pt.overflow_memberships(placed.select(*REP, *POINT, "vf"), placed.select(*REP, "outlet_id", "day_group"), REP, settings.repeats)
        extra = second.filter("to_day is not null").select(*REP, "outlet_id", c("to_day").cast("int").alias("day_group"), c("share").cast("int").alias("visits"))
        pool = pool.unionByName(extra.join(placed.select(*REP, *POINT, "unit"), [*REP, "outlet_id"]).select(*cols))
    band = [*REP, "day_group", "visits"]
    pool = pool.withColumn("weight", c("unit")).withColumn("k", cycle.buckets_for_frequency(c("visits"), r))
    weeks = best_cut(pool, band, settings.band, settings.hop_km, 1.1, 3, polish=False) if settings.search else pt.hilbert_partition(pool, band, c("k"))
    return cut(weeks.select(*REP, "outlet_id", "day_group", "visits", c("group").alias("bucket")))


def day_plan(owned: DataFrame, settings: PlanSettings) -> DataFrame:
    """Day-group, visits and bucket of every outlet of every rep (REP, outlet_id, vf, latitude, longitude)."""
    o = owned if "unit" in owned.columns else weights(owned, ["market_id"], settings)
    o = cut(o.select(*REP, *POINT, "vf", "unit"))
    return week_cut(o, day_cut(o, settings), settings)


def lay_out(members: DataFrame, points: DataFrame, settings: PlanSettings, plan_days: int | None = None) -> DataFrame:
    """Ordered stops of every cell from memberships: CELL, run, day_group, seq, outlet and its figures."""
    visits = expand_visits(members, settings, plan_days)
    stops = visits.join(points.select(*POINT, "vf", "call_minutes"), "outlet_id")
    return order_stops(stops.select(*CELL, "run", "day_group", "visits", "bucket", "bonus", *POINT, "vf", "call_minutes"), CELL, settings.hop_km)


def relieved(stops: DataFrame, points: DataFrame, settings: PlanSettings, plan_days: int | None = None) -> DataFrame:
    """Stops of ``lay_out`` with days over the shift relieved; only the reps concerned are laid out again."""
    stops = cut(stops)
    runs = stops.filter("not bonus").select(*REP, "day_group", "run", "seq", *POINT, "call_minutes", "visits", "bucket")
    late = cut(day_loads(runs, settings.workday).filter(c("minutes") > settings.workday.shift + 1e-6).select(*REP).distinct())
    if late.isEmpty():
        return stops
    eased = relieve_overloaded_days(runs.join(late, REP, "left_semi"), settings)
    members = cut(eased.select(*REP, "outlet_id", "day_group", "visits", "bucket").distinct())
    return stops.join(late, REP, "left_anti").unionByName(lay_out(members, points, settings, plan_days).select(*stops.columns))


def build_plan(outlets: DataFrame, reps: Column, settings: PlanSettings = PlanSettings(), plan_days: int | None = None) -> DataFrame:
    """Stops of a whole plan for every market at once, with ``zone_id``: weights, zones, territories, pockets, pieces
    and their days, feedback of the days to the territories, weeks, relief of long days, calendar and order.

    ``outlets`` are those to plan (market_id, outlet_id, latitude, longitude, vf, call_minutes);
    ``reps`` is the team size, a number or a column of the market. Rep ids are market * 100000 + number.
    """
    o = cut(weights(outlets, ["market_id"], settings))
    own, graph = territories(o, reps, settings)
    owned = cut(o.join(own.select("market_id", "outlet_id", "group"), ["market_id", "outlet_id"]).withColumn(
        "rep_id", (c("market_id") * 100000 + c("group")).cast("bigint")).select(*REP, *POINT, "vf", "call_minutes", "unit"))
    owned, days = feedback(owned, day_cut(owned, settings, graph), graph, settings)
    stops = lay_out(week_cut(owned, days, settings), owned, settings, plan_days)
    return relieved(stops, owned, settings, plan_days).drop("bonus").join(zones(outlets, settings), ["market_id", "outlet_id"], "left")


def replan_reps(owned: DataFrame, reps: DataFrame, settings: PlanSettings) -> DataFrame:
    """A fresh month for the chosen reps only, on the saved settings; territories stay as they are."""
    mine = owned.join(reps.select("rep_id").distinct(), "rep_id", "left_semi")
    return relieved(lay_out(day_plan(mine, settings), mine, settings), mine, settings).drop("bonus")


def resequence(stops: DataFrame, cells: DataFrame, hop_km: float = 4.0) -> DataFrame:
    """Lay a new driving order in the given cells (rep_id, week, day_of_week); all others stay untouched."""
    key = ["rep_id", "week", "day_of_week"]
    chosen = cells.select(*key).distinct()
    again = order_stops(stops.join(chosen, key, "left_semi"), CELL, hop_km)
    return stops.join(chosen, key, "left_anti").unionByName(again.select(stops.columns))


def partial_replan(owned: DataFrame, stops: DataFrame, settings: PlanSettings, void_cells: DataFrame) -> DataFrame:
    """Bring a plan up to date: reps whose outlets changed get a new month, cells with a void distance a
    new order, the rest stay."""
    what = cut(stale_missing(owned, stops, void_cells.select("rep_id")))
    regroup = what.filter("action = 'regroup'").select("rep_id")
    fresh = replan_reps(owned, regroup, settings)
    rest = stops.join(regroup, "rep_id", "left_anti")
    redo = void_cells.join(what.filter("action = 'resequence'").select("rep_id"), "rep_id", "left_semi")
    cols = [*CELL, "seq", "outlet_id"]
    return resequence(rest, redo, settings.hop_km).select(*cols).unionByName(fresh.select(*cols))


def replan_keep_days(owned: DataFrame, stops: DataFrame, settings: PlanSettings, compare: bool = True,
                     pinned: DataFrame | None = None) -> DataFrame:
    """A month after its rep's outlets changed, keeping everyone's day who can keep it.

    The month is read back from its cells; outlets that left are taken out, new ones (and ones moved by
    hand off their pattern) join the day that passes them, and days left outside the band are repaired.
    Outlets in ``pinned`` are not moved off their days. A rep for whom a fresh cut holds better (fewer month
    issues) gets that; ``kept`` tells which.
    """
    bands = cut(read_back_bands(stops, settings))
    own = owned.select(*REP, "outlet_id", "vf")
    stay = bands.filter("bucket is not null").join(own.select(*REP, "outlet_id"), [*REP, "outlet_id"], "left_semi").select(
        *REP, "outlet_id", "day_group", "visits", "bucket")
    arrive = own.join(stay.select(*REP, "outlet_id").distinct(), [*REP, "outlet_id"], "left_anti").withColumn(
        "visits", F.explode(cycle.memberships_for(c("vf"), F.lit(settings.repeats))))
    members = place_arrivals(stay, arrive, owned, settings)
    ordered = lay_out(members, owned, settings)
    runs = ordered.select(*REP, "day_group", "run", "seq", *POINT, "call_minutes", "visits", "bucket")
    baseline = stops.withColumn("_at", cycle.cycle_cell_of(c("week"), c("day_of_week"), settings.week, settings.day_groups, settings.cycle_days, settings.start_slot)).filter(
        "_at is not null").groupBy(*REP, c("_at.day_group").alias("day_group"), c("_at.run").alias("run")).agg(F.count(F.lit(1)).alias("visits"))
    fixed = restore_band(runs, settings, baseline, pinned)
    at = cycle.calendar_cell(c("run"), c("day_group") + 1, F.lit(settings.day_groups), settings.week, settings.start_slot)
    kept = cut(fixed.withColumn("_at", at).select(*REP, c("_at.week").alias("week"), c("_at.day_of_week").alias("day_of_week"), "run", "day_group", "seq", *POINT, "call_minutes"))
    if not compare:
        return kept.withColumn("kept", F.lit(True))
    fresh = cut(lay_out(day_plan(owned, settings), owned, settings).select(kept.columns))
    score = lambda df, name: month_issues(scorecard_days(route_legs(df)), settings.band, settings.workday).withColumnRenamed("issues", name)
    better = score(kept, "a").join(score(fresh, "b"), REP, "full").select(*REP, (F.coalesce("b", F.lit(0.0)) < F.coalesce("a", F.lit(0.0))).alias("_fresh"))
    return kept.join(better.filter("not _fresh").select(*REP), REP, "left_semi").withColumn("kept", F.lit(True)).unionByName(
        fresh.join(better.filter("_fresh").select(*REP), REP, "left_semi").withColumn("kept", F.lit(False)))
