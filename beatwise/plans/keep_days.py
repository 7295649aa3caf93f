"""Changing a driven month as little as possible: reading it back, placing arrivals, relieving days."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatwise.functions import cycle
from beatwise.functions.geo import haversine_km
from beatwise.operators.neighbours import nearest
from beatwise.operators.prefix import running_total, with_previous
from beatwise.operators.routes import cheapest_insertion
from beatwise.operators.spots import mirror_cells
from beatwise.params import PlanSettings, Workday
from beatwise.plans import relief
from beatwise.session import cut

c = F.col
REP = ["market_id", "rep_id"]
RUN = ["market_id", "rep_id", "day_group", "run"]
#: Stops of a rep up to which one task goes through all its rounds of relief, and the stops such a task gets about.
REP_STOPS, TASK_STOPS = 4096, 16384


def read_back_bands(stops: DataFrame, settings: PlanSettings) -> DataFrame:
    """Day-group, visits and bucket of every outlet, recovered from its cells; ``bucket`` is null (irregular)
    where its runs fit no pattern. Bonus days and days off the working week are left out."""
    r = F.lit(settings.repeats)
    at = cycle.cycle_cell_of(c("week"), c("day_of_week"), settings.week, settings.day_groups, settings.cycle_days, settings.start_slot)
    seen = stops.withColumn("_at", at).filter("_at is not null").groupBy(*REP, "outlet_id", c("_at.day_group").alias("day_group")).agg(
        F.array_sort(F.collect_set("_at.run")).alias("runs"))
    v = F.size("runs")
    fits = F.filter(F.sequence(F.lit(0), cycle.buckets_for_frequency(v, r) - 1), lambda b: cycle.runs_of_bucket(v, r, b) == c("runs"))
    return seen.select(*REP, "outlet_id", "day_group", v.alias("visits"), F.get(fits, 0).alias("bucket"), "runs")


def runs_of(members: DataFrame, repeats: int) -> DataFrame:
    """Memberships spelled out per run."""
    return members.withColumn("run", F.explode(cycle.runs_of_bucket(c("visits"), F.lit(repeats), c("bucket"))))


def place_arrivals(members: DataFrame, arrivals: DataFrame, points: DataFrame, settings: PlanSettings) -> DataFrame:
    """Memberships with arriving outlets (REP, outlet_id, visits) added to the day that already passes them.

    A bucket's distance is the worst of its runs' nearest stops. Among buckets about as near as the
    nearest (25% and 50 m), one with room under the ceiling comes first, then the one with fewest
    calls. Day-groups without stops are used only where there is no other. Several arrivals enter a
    day in one round while it has room, one where it has none; the rest see the updated days in the next.
    """
    keep = [*REP, "outlet_id", "day_group", "visits", "bucket"]
    r = F.lit(settings.repeats)
    pos = cut(points.select("outlet_id", "latitude", "longitude"))
    state = cut(members.select(*keep))
    left = cut(arrivals.select(*REP, "outlet_id", "visits").join(pos, "outlet_id"))
    span = lambda n: F.sequence(F.lit(0), n - 1)
    while not left.isEmpty():
        # Only days of reps that still wait for an arrival are looked at.
        waiting = state.join(left.select(*REP).distinct(), REP, "left_semi")
        driven = runs_of(waiting.join(pos.hint("shuffle_hash"), "outlet_id"), settings.repeats)
        load = driven.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"))
        asks = left.withColumn("day_group", F.explode(span(F.lit(settings.day_groups)))).withColumn("run", F.explode(F.sequence(F.lit(1), r)))
        near = nearest(asks, driven, RUN, 1, not_self=False).select(*RUN, "outlet_id", "km")
        opts = left.withColumn("day_group", F.explode(span(F.lit(settings.day_groups)))).withColumn(
            "bucket", F.explode(span(cycle.buckets_for_frequency(c("visits"), r)))).withColumn(
            "run", F.explode(cycle.runs_of_bucket(c("visits"), r, c("bucket"))))
        b = opts.join(near, [*RUN, "outlet_id"], "left").join(load, RUN, "left").groupBy(*keep).agg(
            F.max(F.coalesce("km", F.lit(0.0))).alias("near"), F.max(F.coalesce("n", F.lit(0))).alias("count"), F.max(c("n").isNull()).alias("empty"))
        mine = Window.partitionBy(*REP, "outlet_id")
        b = b.withColumn("_some", F.min(c("empty").cast("int")).over(mine)).filter(~c("empty") | (c("_some") == 1))
        b = b.withColumn("_near", F.min("near").over(mine)).filter(c("near") <= c("_near") * 1.25 + 0.05)
        full = c("count") + 1 > settings.band.high
        pick = b.groupBy(*REP, "outlet_id", "visits").agg(F.min(F.struct(full.cast("int").alias("full"), "count", "near", "day_group", "bucket")).alias("p"))
        pick = pick.select(*REP, "outlet_id", "visits", c("p.day_group").alias("day_group"), c("p.bucket").alias("bucket"), c("p.count").alias("count"))
        turn = Window.partitionBy(*REP, "day_group").orderBy("outlet_id")
        pick = pick.withColumn("_r", F.row_number().over(turn))
        pick = cut(pick.filter((c("_r") == 1) | (c("count") + c("_r") <= settings.band.high)).select(*keep))
        state = cut(state.unionByName(pick))
        left = cut(left.join(pick.select(*REP, "outlet_id"), [*REP, "outlet_id"], "left_anti"))
    return state


# ------------------------------------------------------------------ relieving days

def day_loads(stops: DataFrame, wd: Workday = Workday()) -> DataFrame:
    """Calls, km and minutes of every run of every day-group from its stops in order."""
    legs = with_previous(stops, RUN, "seq", {"_la": "latitude", "_lo": "longitude"})
    km = F.coalesce(haversine_km(c("_la"), c("_lo"), c("latitude"), c("longitude")), F.lit(0.0))
    d = legs.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"), F.sum(km).alias("km"), F.sum("call_minutes").alias("call"))
    return d.withColumn("minutes", c("call") + c("km") * F.lit(wd.detour / wd.speed_kmh * 60) + F.lit(wd.commute + wd.pause))


def _cost(minutes: Column, n: Column, shift: float, low: Column, high: Column, weight: float) -> Column:
    over = F.greatest(F.lit(0.0), minutes - shift)
    gap = F.greatest(F.lit(0), low - n, n - high)
    return over * over + 2 * minutes + F.lit(weight) * gap * gap


COLS = [*RUN, "seq", "outlet_id", "latitude", "longitude", "call_minutes", "visits", "bucket"]


def _judged(state: DataFrame, settings: PlanSettings, restore: DataFrame | None) -> DataFrame:
    """Loads of the days with their band, their distance to it, their cost, and whether they are to give or to take."""
    d = day_loads(state, settings.workday).withColumn("low", F.lit(settings.band.low)).withColumn("high", F.lit(settings.band.high))
    late = c("minutes") > settings.workday.shift + 1e-6
    if restore is None:
        return d.withColumn("gap", F.greatest(F.lit(0), c("low") - c("n"), c("n") - c("high"))).withColumns(
            {"cost": _cost(c("minutes"), c("n"), settings.workday.shift, c("low"), c("high"), 0.0), "gives": late, "takes": F.lit(False)})
    was = restore.select(*RUN, c("visits").alias("_was"))
    d = d.join(was, RUN, "left").withColumn("low", F.least("low", F.coalesce("_was", "low"))).withColumn("high", F.greatest("high", F.coalesce("_was", "high"))).drop("_was")
    return d.withColumn("gap", F.greatest(F.lit(0), c("low") - c("n"), c("n") - c("high"))).withColumns(
        {"cost": _cost(c("minutes"), c("n"), settings.workday.shift, c("low"), c("high"), 10000.0), "gives": late | (c("n") > c("high")), "takes": c("n") < c("low")})


def relief_moves(state: DataFrame, days: DataFrame, settings: PlanSettings, restore: bool = False, pinned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Moves of one round, and the slots they take.

    Every move of an outlet that takes it off a day that is to give, or onto one that is to take, is priced: legs
    saved where it leaves, cheapest slot where it joins. From the best move on, each is chosen that shares no day and
    no outlet with one chosen before, so the gains of a round add up; a rep's moves are gone through in one step. No receiving day ends longer than the longest giving one was, no band gap or count of legs over the hop grows, and outlets
    that share their spot with another stop stay.
    """
    wd, shift, hop = settings.workday, settings.workday.shift, settings.hop_km
    per_km = wd.detour / wd.speed_kmh * 60
    weight = 10000.0 if restore else 0.0
    r = F.lit(settings.repeats)
    # What a rep is to give and take: the runs of its cycle, a few dozen at most.
    cell = F.struct("day_group", "run", "minutes")
    wants = days.groupBy(*REP).agg(F.collect_list(F.when(c("gives"), cell)).alias("giving"), F.collect_list(F.when(c("takes"), cell)).alias("taking"))
    legs = with_previous(state, RUN, "seq", {"pla": "latitude", "plo": "longitude"})
    nxt = state.select(*RUN, (c("seq") - 1).alias("seq"), c("latitude").alias("nla"), c("longitude").alias("nlo"))
    full = cut(legs.join(nxt, [*RUN, "seq"], "left"))
    dist = lambda a, b, e, f: haversine_km(c(a), c(b), c(e), c(f))
    at = full.withColumn("k_in", dist("pla", "plo", "latitude", "longitude")).withColumn("k_out", dist("latitude", "longitude", "nla", "nlo")).withColumn("k_gap", dist("pla", "plo", "nla", "nlo"))
    zero, long_ = (lambda x: F.coalesce(x, F.lit(0.0))), (lambda x: F.coalesce((x > hop).cast("int"), F.lit(0)))
    stuck = F.coalesce(F.least(c("k_in"), c("k_out")) < 0.005, F.lit(False))
    removal = at.select(*RUN, "outlet_id", (zero(c("k_in")) + zero(c("k_out")) - zero(c("k_gap"))).alias("saved"),
                        (long_(c("k_gap")) - long_(c("k_in")) - long_(c("k_out"))).alias("long_out"), stuck.alias("stuck"))
    one = full.groupBy(*REP, "outlet_id", "day_group", "visits", "bucket").agg(
        F.first("latitude").alias("latitude"), F.first("longitude").alias("longitude"), F.first("call_minutes").alias("call_minutes")).join(wants, REP)
    if pinned is not None:
        one = one.join(pinned.select("outlet_id").distinct(), "outlet_id", "left_anti")
    opt = one.withColumn("d2", F.explode(F.sequence(F.lit(0), F.lit(settings.day_groups - 1)))).withColumn("b2", F.explode(F.sequence(F.lit(0), cycle.buckets_for_frequency(c("visits"), r) - 1)))
    opt = opt.filter(~((c("d2") == c("day_group")) & (c("b2") == c("bucket"))))
    frm, to = cycle.runs_of_bucket(c("visits"), r, c("bucket")), cycle.runs_of_bucket(c("visits"), r, c("b2"))
    same = c("d2") == c("day_group")
    opt = opt.withColumn("give", F.when(same, F.array_except(frm, to)).otherwise(frm)).withColumn("recv", F.when(same, F.array_except(to, frm)).otherwise(to))
    off = F.filter("giving", lambda x: (x["day_group"] == c("day_group")) & F.array_contains(c("give"), x["run"]))
    onto = F.exists("taking", lambda x: (x["day_group"] == c("d2")) & F.array_contains(c("recv"), x["run"]))
    opt = opt.withColumn("w_min", F.array_max(F.transform(off, lambda x: x["minutes"]))).filter(c("w_min").isNotNull() | onto).drop("giving", "taking")
    opt = cut(opt)
    key = [*REP, "outlet_id", "day_group", "bucket", "d2", "b2"]
    dg = days.select(*RUN, "n", "minutes", "cost", "low", "high", "gap")
    gap_after = lambda n: F.greatest(F.lit(0), c("low") - n, n - c("high"))
    g = opt.withColumn("run", F.explode("give")).join(removal, [*RUN, "outlet_id"]).join(dg, RUN)
    g_min = F.when(c("n") > 1, c("minutes") - c("call_minutes") - c("saved") * per_km).otherwise(0.0)
    g = g.groupBy(*key).agg(
        F.sum(c("cost") - F.when(c("n") > 1, _cost(g_min, c("n") - 1, shift, c("low"), c("high"), weight)).otherwise(0.0)).alias("gain_g"),
        F.sum("long_out").alias("long_g"), F.max("stuck").alias("stuck"), F.sum(F.when(c("n") > 1, gap_after(c("n") - 1) - c("gap")).otherwise(-c("gap"))).alias("gap_g"))
    asks = opt.withColumn("run", F.explode("recv")).select(*REP, c("d2").alias("day_group"), "run", "outlet_id", "latitude", "longitude").distinct()
    slot = state.select(*RUN, "seq", "latitude", "longitude")
    prev = with_previous(slot, RUN, "seq", {"pla": "latitude", "plo": "longitude"}).select(*RUN, c("seq").alias("at"), "pla", "plo", c("latitude").alias("nla"), c("longitude").alias("nlo"))
    tail = slot.groupBy(*RUN).agg(F.max(F.struct("seq", "latitude", "longitude")).alias("l")).select(
        *RUN, (c("l.seq") + 1).alias("at"), c("l.latitude").alias("pla"), c("l.longitude").alias("plo"), F.lit(None).cast("double").alias("nla"), F.lit(None).cast("double").alias("nlo"))
    ins = asks.join(prev.unionByName(tail), RUN)
    p_in, p_out, p_gap = dist("pla", "plo", "latitude", "longitude"), dist("latitude", "longitude", "nla", "nlo"), dist("pla", "plo", "nla", "nlo")
    ins = cut(ins.groupBy(*RUN, "outlet_id").agg(
        F.min(F.struct(F.round(zero(p_in) + zero(p_out) - zero(p_gap), 9).alias("add"), c("at"), (long_(p_in) + long_(p_out) - long_(p_gap)).alias("long"))).alias("s"),
        F.min(F.least(p_in, p_out)).alias("near")).withColumnRenamed("day_group", "d2"))
    h = opt.withColumn("run", F.explode("recv")).join(ins, [*REP, "d2", "run", "outlet_id"], "left").join(
        dg.withColumnRenamed("day_group", "d2"), [*REP, "d2", "run"], "left")
    h_min = c("minutes") + c("call_minutes") + c("s.add") * per_km
    km_leg = F.when(c("n") > 1, (c("minutes") - 70) / per_km / c("n")).otherwise(c("near"))
    h = h.groupBy(*key, "w_min").agg(
        F.sum(c("cost") - _cost(h_min, c("n") + 1, shift, c("low"), c("high"), weight)).alias("gain_h"), F.max(c("n").isNull()).alias("closed"), F.sum("s.long").alias("long_h"),
        F.max(h_min).alias("longest"), F.sum(gap_after(c("n") + 1) - c("gap")).alias("gap_h"), F.max(c("near") / F.greatest(F.lit(0.03), km_leg)).alias("reach"))
    m = h.join(g, key, "left").fillna(0, ["gain_g", "long_g", "gap_g"]).fillna(False, ["stuck"])
    ok = (~c("closed") & ~c("stuck") & (c("gain_g") + c("gain_h") > 1e-6) & (c("long_g") + c("long_h") <= 0) & (c("gap_g") + c("gap_h") <= 0) & (c("reach") <= 3)
          & (F.lit(restore) | (c("longest") <= c("w_min") + 1e-6)))
    ring = F.greatest(F.lit(0), F.ceil("reach") - 1)
    rank = F.struct(ring.alias("ring"), (-F.round(c("gain_g") + c("gain_h"), 6)).alias("g"), "outlet_id", "d2", "b2", "day_group", "bucket")
    good = cut(m.filter(ok).select(*key, rank.alias("rank")).join(opt.select(*key, "give", "recv", "latitude", "longitude", "call_minutes", "visits"), key))
    touched = F.concat(F.transform("give", lambda x: F.struct(c("day_group").cast("bigint").alias("a"), x.alias("b"))),
                       F.transform("recv", lambda x: F.struct(c("d2").cast("bigint").alias("a"), x.alias("b"))),
                       F.array(F.struct(c("outlet_id").cast("bigint").alias("a"), F.lit(-1).alias("b"))))
    # No more moves than the rep has days can be chosen, so of those that touch the same days only so many can be among them.
    alike = Window.partitionBy(*REP, "day_group", "d2", "give", "recv").orderBy("rank")
    cells = days.groupBy(*REP).agg(F.count(F.lit(1)).alias("cells"))
    pool = good.withColumn("_r", F.row_number().over(alike)).join(cells, REP).filter("_r <= cells").select(*REP, "rank", touched.alias("touched"))
    chosen = pool.groupBy(*REP).agg(F.sort_array(F.collect_list(F.struct("rank", "touched"))).alias("moves"))
    none = F.struct(F.array().cast(pool.select(F.array("rank")).schema[0].dataType).alias("ranks"), F.array().cast(pool.schema["touched"].dataType).alias("taken"))
    # What shares a day or an outlet with a chosen move waits for the next round's prices.
    take = lambda so_far, m: F.when(F.arrays_overlap(so_far["taken"], m["touched"]), so_far).otherwise(
        F.struct(F.concat(so_far["ranks"], F.array(m["rank"])).alias("ranks"), F.concat(so_far["taken"], m["touched"]).alias("taken")))
    chosen = chosen.select(*REP, F.explode(F.aggregate("moves", none, take, lambda x: x["ranks"])).alias("rank"))
    return cut(good.join(chosen, [*REP, "rank"])), ins


def relieve_overloaded_days(stops: DataFrame, settings: PlanSettings, restore: DataFrame | None = None, pinned: DataFrame | None = None,
                            rounds: int | None = None) -> DataFrame:
    """Move outlets from a rep's overlong days to others of its days while that lowers the overtime.

    ``stops``: RUN keys, seq, outlet_id, latitude, longitude, call_minutes, visits, bucket. Each round makes the
    moves of ``relief_moves``; the cost (overtime squared, twice the minutes, and what the band is missed by)
    falls with every move, so the rounds end when no move is left. Reps without a move leave the loop. With
    ``restore`` (a baseline: RUN keys, visits) days an edit left outside the band, measured against what they
    were, give or take outlets too. ``rounds`` stops early.

    Reps of up to REP_STOPS stops with known figures, whose days are numbered without a gap, go through all rounds in one task
    with others (``relief``); the rest by joins, round by round.
    """
    live = cut(stops.select(*COLS))
    known = F.lit(True)
    for x in COLS:
        known &= c(x).isNotNull()
    for x in ("latitude", "longitude", "call_minutes"):
        known &= ~F.isnan(c(x).cast("double"))
    inside = (c("day_group") >= 0) & (c("day_group") < settings.day_groups) & (c("run") >= 1) & (c("run") <= settings.repeats)
    inside &= (c("visits") >= 1) & (c("bucket") >= 0) & (c("bucket") < settings.repeats)
    day = live.groupBy(*RUN).agg(F.count(F.lit(1)).alias("_n"), F.min("seq").alias("_a"), F.max("seq").alias("_b"), F.count_distinct("seq").alias("_s"),
                                 F.count_distinct("outlet_id").alias("_o"), F.min(F.coalesce(known & inside, F.lit(False))).alias("_ok"))
    whole = c("_ok") & (c("_a") == 1) & (c("_b") == c("_n")) & (c("_s") == c("_n")) & (c("_o") == c("_n"))
    if restore is not None:
        day = day.join(restore.groupBy(*RUN).agg(F.count(F.lit(1)).alias("_times")), RUN, "left")
        whole &= F.coalesce("_times", F.lit(1)) == 1
    size = day.groupBy(*REP).agg((F.min(F.coalesce(whole, F.lit(False))) & (F.sum("_n") <= REP_STOPS)).alias("_few"), F.sum("_n").alias("_stops"))
    # Where an outlet's rows differ in place or length of call, which of them counts is left to the joins.
    same = live.groupBy(*REP, "outlet_id").agg((F.count_distinct("latitude", "longitude", "call_minutes") <= 1).alias("_one")).groupBy(*REP).agg(F.min("_one").alias("_one"))
    size = cut(size.join(same, REP, "left").select(*REP, "_stops", (c("_few") & F.coalesce("_one", F.lit(False))).alias("_few")))
    counts = size.agg(F.sum(F.when(c("_few"), c("_stops"))).alias("s")).first()["s"]
    if not counts:
        return _relieved_by_joins(live, settings, restore, pinned, rounds)
    few = size.filter("_few").select(*REP)
    told = live.join(few, REP, "left_semi")
    told = told.withColumn("_pin", F.lit(False)) if pinned is None else told.join(
        pinned.select("outlet_id").distinct().withColumn("_pin", F.lit(True)), "outlet_id", "left").withColumn("_pin", F.coalesce("_pin", F.lit(False)))
    told = told.withColumn("_was", F.lit(None).cast("long")) if restore is None else told.join(restore.select(*RUN, c("visits").cast("long").alias("_was")), RUN, "left")
    told = told.withColumn("_task", F.pmod(F.xxhash64(*REP), F.lit(max(1, -(-counts // TASK_STOPS)))))
    eased = cut(told.groupBy("_task").applyInArrow(relief.settled(settings, restore is not None, rounds, COLS), live.schema))
    if size.filter("not _few").isEmpty():
        return eased
    return eased.unionByName(_relieved_by_joins(live.join(few, REP, "left_anti"), settings, restore, pinned, rounds))


def _relieved_by_joins(stops: DataFrame, settings: PlanSettings, restore: DataFrame | None, pinned: DataFrame | None, rounds: int | None) -> DataFrame:
    live, settled, done = cut(stops.select(*COLS)), None, 0
    while rounds is None or done < rounds:
        d = cut(_judged(live, settings, restore))
        reps = d.filter(c("gives") | c("takes")).select(*REP).distinct()
        go, ins = relief_moves(live.join(reps, REP, "left_semi"), d.join(reps, REP, "left_semi"), settings, restore is not None, pinned)
        if go.isEmpty():
            break
        busy = go.select(*REP).distinct()
        rest = live.join(busy, REP, "left_anti")
        settled = rest if settled is None else settled.unionByName(rest)
        live = live.join(busy, REP, "left_semi")
        # Leave the given runs, take the slot in the received ones, carry the new bucket everywhere.
        out = go.select(*REP, "outlet_id", "day_group", F.explode("give").alias("run")).withColumn("_out", F.lit(True))
        renamed = go.select(*REP, "outlet_id", "day_group", "d2", c("b2").alias("_b2")).filter("d2 = day_group").drop("d2")
        kept = live.join(out, [*RUN, "outlet_id"], "left").filter("_out is null").drop("_out").join(renamed, [*REP, "outlet_id", "day_group"], "left").withColumn(
            "bucket", F.coalesce("_b2", "bucket")).drop("_b2").withColumn("_key", c("seq").cast("double"))
        came = go.withColumn("run", F.explode("recv")).join(ins.select(*REP, "d2", "run", "outlet_id", "s"), [*REP, "d2", "run", "outlet_id"]).select(
            *REP, c("d2").alias("day_group"), "run", (c("s.at")).cast("int").alias("seq"), "outlet_id", "latitude", "longitude", "call_minutes", "visits", c("b2").alias("bucket"), (c("s.at") - 0.5).alias("_key"))
        both = kept.select(*COLS, "_key").unionByName(came.select(*COLS, "_key")).drop("seq")
        live = cut(running_total(both, RUN, F.floor(c("_key") / 4096), ["_key", "outlet_id"], F.lit(1), "seq").withColumn("seq", c("seq").cast("int")).select(*COLS))
        done += 1
    return live if settled is None else settled.unionByName(live)


def restore_band(stops: DataFrame, settings: PlanSettings, baseline: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """Put right the days an edit broke, each against what it was (``baseline``: RUN keys, visits)."""
    return relieve_overloaded_days(stops, settings, baseline, pinned)


# ------------------------------------------------------------------ pins

def place_pins(stops: DataFrame, pins: DataFrame, points: DataFrame) -> DataFrame:
    """Stops after hand placements (rep_id, outlet_id, week, day_of_week; one per outlet).

    A pinned outlet is driven in its pinned cell, then in the cells that mirror it, then where it was,
    until it has as many visits as before; it enters at the cheapest slot and leaves its other cells.
    Pins whose rep or cell is gone are dropped.
    """
    cell = ["rep_id", "week", "day_of_week"]
    live = pins.join(stops.select(*cell).distinct(), cell, "left_semi")
    had = stops.groupBy("outlet_id").agg(F.count(F.lit(1)).alias("_had"), F.max("market_id").alias("market_id"))
    p = cut(live.join(had, "outlet_id", "left").withColumn("_had", F.coalesce("_had", F.lit(1))))
    mirrors = mirror_cells(stops, p.select(*cell)).select("rep_id", "day_of_week", "target_week", c("week").alias("_w"))
    near = p.join(mirrors.withColumnRenamed("target_week", "week"), ["rep_id", "day_of_week", "week"]).select(
        "outlet_id", "rep_id", c("_w").alias("week"), "day_of_week", "_had", F.when(c("_w") == c("week"), 0).otherwise(1).alias("_o"))
    was = stops.join(p.select("outlet_id", "_had"), "outlet_id").select("outlet_id", "rep_id", "week", "day_of_week", "_had", F.lit(2).alias("_o"))
    want = near.unionByName(was).groupBy("outlet_id", "rep_id", "week", "day_of_week", "_had").agg(F.min("_o").alias("_o"))
    w = Window.partitionBy("outlet_id").orderBy("_o", "week", "day_of_week", "rep_id")
    want = cut(want.withColumn("_r", F.row_number().over(w)).filter(c("_r") <= c("_had")).select("outlet_id", *cell))
    now = stops.join(p.select("outlet_id").distinct().withColumn("_pin", F.lit(True)), "outlet_id", "left")
    kept = now.join(want.withColumn("_want", F.lit(True)), ["outlet_id", *cell], "left").filter("_pin is null or _want").select(
        *cell, "outlet_id", c("seq").cast("double").alias("_key"))
    kept = cut(kept)
    fresh = want.join(kept.select("outlet_id", *cell), ["outlet_id", *cell], "left_anti").join(points.select("outlet_id", "latitude", "longitude"), "outlet_id")
    base = running_total(kept, cell, F.floor(c("_key") / 4096), ["_key", "outlet_id"], F.lit(1), "seq").drop("_key").join(
        points.select("outlet_id", "latitude", "longitude"), "outlet_id")
    slots = cheapest_insertion(base, fresh, cell)
    both = base.select(*cell, "outlet_id", c("seq").cast("double").alias("_key")).unionByName(slots.select(*cell, "outlet_id", (c("at") - 0.5).alias("_key")))
    return running_total(both, cell, F.floor(c("_key") / 4096), ["_key", "outlet_id"], F.lit(1), "seq").select(*cell, "outlet_id", c("seq").cast("int").alias("seq"))
