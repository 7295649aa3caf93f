"""What a market is like and what it needs: shape, workload, team size, blueprint."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwise.functions import text
from beatwise.functions.geo import haversine_km, point_in_ring, ring_literal
from beatwise.functions.numbers import half_up, nearest_rank
from beatwise.operators.neighbours import nearest
from beatwise.operators.prefix import median_of, median_ranks, order_statistics
from beatwise.params import COUNTRY_BOXES, LEBANON_OUTLINE, MONDAY_WEEK, WEEKDAY_SHORT, Workday
from beatwise.session import cut

HOP_CAP_KM = 6.0


def frequency_mix(outlets: DataFrame, keys: list[str]) -> DataFrame:
    return outlets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("outlets"), *[F.count_if(F.col("vf") == v).alias(f"vf{v}") for v in (1, 2, 3, 4)],
        F.sum(F.when(F.col("vf") > 0, F.col("vf")).otherwise(1)).alias("monthly_visits"))


def channel_mix(outlets: DataFrame, keys: list[str]) -> DataFrame:
    """Outlets per channel with its call minutes, ranked by count."""
    from pyspark.sql import Window
    key = text.classify_channel(F.col("channel"))
    counts = outlets.withColumn("channel_key", key).filter("channel_key is not null").groupBy(*keys, "channel_key").agg(
        F.count(F.lit(1)).alias("outlets"))
    order = Window.partitionBy(*keys).orderBy(F.desc("outlets"), "channel_key")
    return counts.withColumn("call_minutes", text.channel_minutes(F.col("channel_key"))).withColumn(
        "place", F.row_number().over(order))


def second_neighbours(outlets: DataFrame, keys: list[str], upto: int = 3) -> DataFrame:
    """Outlets with the distance to their 2nd and 3rd nearest neighbour (nn2, nn3), 0 where there is none."""
    near = nearest(outlets, outlets, keys, upto).groupBy(*keys, "outlet_id").agg(
        *[F.max(F.when(F.col("rank") == r, F.col("km"))).alias(f"nn{r}") for r in range(2, upto + 1)])
    return outlets.join(near, [*keys, "outlet_id"], "left").fillna(0.0, [f"nn{r}" for r in range(2, upto + 1)])


def centre(outlets: DataFrame, keys: list[str]) -> DataFrame:
    """Median latitude and longitude per key, exact."""
    lat = order_statistics(outlets, keys, "latitude", median_ranks("lat")).select(*keys, median_of("lat").alias("centre_lat"))
    lng = order_statistics(outlets, keys, "longitude", median_ranks("lng")).select(*keys, median_of("lng").alias("centre_lng"))
    return lat.join(lng, keys)


def market_shape(near: DataFrame, keys: list[str]) -> DataFrame:
    """Centre, 90% radius, median 2nd-neighbour distance and character of a market (from second_neighbours)."""
    n = F.col("n")
    long = near.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("_m"), F.col(m).alias("_x"))
                                                 for m in ("latitude", "longitude", "nn2", "nn3")])))
    stats = cut(order_statistics(long, [*keys, "_m"], "_x", {**median_ranks("x"), "p75": nearest_rank(0.75, n)}))
    pick = lambda m, what: F.max(F.when(F.col("_m") == m, what))
    mid = stats.groupBy(*keys).agg(
        pick("latitude", median_of("x")).alias("centre_lat"), pick("longitude", median_of("x")).alias("centre_lng"),
        pick("nn2", median_of("x")).alias("neighbour_km"), pick("nn3", F.col("p75")).alias("nn3_p75"))
    away = near.join(mid, keys).withColumn("_d", haversine_km(F.col("centre_lat"), F.col("centre_lng"), F.col("latitude"), F.col("longitude")))
    radius = order_statistics(away, keys, "_d", {"radius_km": nearest_rank(0.9, n)}).select(*keys, "radius_km", "n")
    d = F.col("neighbour_km")
    kind = (F.when(d < 0.12, "dense city").when(d < 0.3, "city").when(d < 0.8, "city and towns").otherwise("towns and villages"))
    return (mid.join(radius, keys).withColumn("character", kind)
            .withColumnRenamed("n", "outlets"))


def guess_country(lat: Column, lng: Column) -> Column:
    """The first country whose box (Lebanon: outline) holds a point; null outside all."""
    out = None
    for name, a, b, x, y, _ in COUNTRY_BOXES:
        inside = (point_in_ring(ring_literal(LEBANON_OUTLINE), lng, lat) if name == "Lebanon"
                  else lat.between(a, b) & lng.between(x, y))
        out = F.when(inside, F.lit(name)) if out is None else out.when(inside, F.lit(name))
    return out


def week_of_country(country: Column) -> Column:
    """Usual working week (ISO weekdays in order) of a country."""
    out = None
    for name, *_, week in COUNTRY_BOXES:
        days = F.array(*[F.lit(d) for d in week])
        out = F.when(country == name, days) if out is None else out.when(country == name, days)
    return out.otherwise(F.array(*[F.lit(d) for d in MONDAY_WEEK]))


def week_label(days: Column) -> Column:
    name = lambda d: F.element_at(F.array(*[F.lit(x) for x in WEEKDAY_SHORT]), d)
    return F.when(F.size(days) > 2, F.concat_ws("-", name(F.element_at(days, 1)), name(F.element_at(days, -1)))).otherwise(
        F.array_join(F.transform(days, name), ", "))


def per_visit_minutes(wd: Workday) -> Column:
    """Call minutes of an outlet plus the drive to about its second-nearest neighbour."""
    return F.col("call_minutes") + F.least(F.col("nn2"), F.lit(HOP_CAP_KM)) * F.lit(wd.detour / wd.speed_kmh * 60)


def workload_model(near: DataFrame, keys: list[str], wd: Workday = Workday()) -> DataFrame:
    """Visit-weighted call minutes, travel per call, calls a day the shift sustains, and how uneven work is."""
    vf = F.when(F.col("vf") > 0, F.col("vf")).otherwise(1)
    sums = near.withColumn("_w", vf).withColumn("_m", per_visit_minutes(wd)).groupBy(*keys).agg(
        F.sum("_w").alias("monthly_visits"), F.sum(F.col("_w") * F.col("call_minutes")).alias("_call"),
        F.avg(F.least(F.col("nn2"), F.lit(HOP_CAP_KM))).alias("_km"),
        F.sum(F.col("_w") * F.col("_m")).alias("_wm"), F.sum(F.col("_w") * F.col("_m") * F.col("_m")).alias("_wmm"))
    v = F.col("monthly_visits")
    call, travel = F.col("_call") / v, F.col("_km") * F.lit(wd.detour / wd.speed_kmh * 60)
    mean = F.col("_wm") / v
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_wmm") / v - mean * mean)) / mean
    calls = F.greatest(F.lit(4), F.floor(F.lit(wd.productive) / F.greatest(F.lit(1.0), call + travel))).cast("int")
    return sums.select(*keys, "monthly_visits", call.alias("call_min"), travel.alias("travel_min"), calls.alias("sustainable_calls"),
                       spread.alias("spread"), F.when(spread > 0.2, "time").otherwise("visits").alias("balance_by"))


def workload_weights(near: DataFrame, keys: list[str], wd: Workday = Workday()) -> DataFrame:
    """Weight of each outlet's visit against the visit-weighted mean, within 0.3 to 4."""
    vf = F.when(F.col("vf") > 0, F.col("vf")).otherwise(1)
    raw = near.withColumn("_m", per_visit_minutes(wd))
    mean = raw.groupBy(*keys).agg((F.sum(vf * F.col("_m")) / F.sum(vf)).alias("_mean"))
    return raw.join(mean, keys).select(*keys, "outlet_id", F.greatest(F.lit(0.3), F.least(
        F.lit(4.0), F.col("_m") / F.greatest(F.lit(1e-6), F.col("_mean")))).alias("weight"))


def choose_headcount(frame: DataFrame, visits: str, slots: str, low: str, high: str) -> DataFrame:
    """Add ``headcount``: STRUCT(reps, visits_per_day, fits) and ``options``, team sizes worth a look (up to 6)."""
    v, d = F.col(visits).cast("double"), F.greatest(F.lit(1), F.col(slots))
    lo = F.greatest(F.lit(1), F.least(F.col(low), F.col(high)))
    hi = F.greatest(lo, F.col(high))
    per_day = lambda k: v / (F.greatest(F.lit(1), k) * d)
    fits = lambda k: (per_day(k) >= lo - 1e-9) & (per_day(k) <= hi + 1e-9)
    one = lambda k: F.struct(k.cast("int").alias("reps"), half_up(per_day(k), 1).alias("visits_per_day"), fits(k).alias("fits"))
    fewest = F.greatest(F.lit(1), F.ceil(v / (d * hi))).cast("int")
    most = F.greatest(F.lit(1), F.floor(v / (d * lo))).cast("int")
    middle = F.least(F.greatest(F.floor(v / (d * ((lo + hi) / 2)) + 0.5).cast("int"), fewest), most)
    cost = lambda k: (F.when(per_day(k) > hi, 1.5 * (per_day(k) - hi) / hi)
                      .when(per_day(k) < lo, (lo - per_day(k)) / lo).otherwise(0.0))
    chosen = F.when(v <= 0, F.lit(1)).when(fewest <= most, middle).when(cost(fewest) < cost(most) - 1e-12, fewest).otherwise(most)
    start = F.greatest(F.lit(1), F.least(chosen, fewest) - 1)
    stop = F.greatest(chosen, most) + 1
    options = F.when(v <= 0, F.array(one(F.lit(1)))).otherwise(F.transform(F.sequence(start, F.least(stop, start + 5)), one))
    return frame.withColumn("headcount", one(chosen)).withColumn("options", options)


def headcount_for_shift(reps: Column, visits: Column, slots: Column, per_call: Column, floor: Column, wd: Workday) -> Column:
    """Team size after adding reps while the mean day is over 95% of the shift and days keep 90% of the floor."""
    need = F.ceil(visits * per_call / (slots * F.lit(0.95 * wd.shift - wd.commute - wd.pause)) - 1e-9)
    room = F.floor(visits / (slots * floor * 0.9) + 1e-9)
    return F.greatest(reps, F.least(need, F.greatest(reps, room))).cast("int")


def blueprint(outlets: DataFrame, keys: list[str], wd: Workday = Workday(), saved: DataFrame | None = None,
              choice: dict | None = None) -> DataFrame:
    """One row per market: shape, frequencies, workload, proposed setup, team and readiness checks.

    ``outlets`` has excluded/offset flags. Setup: the planner's ``choice`` (low, high, hop_km,
    balance_by) wins over a ``saved`` plan (keys + country, low, high) of the same country, which
    wins over what the data suggests.
    """
    choice = choice or {}
    status = outlets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("listed"), F.count_if("excluded").alias("excluded"),
        F.count_if(~F.col("excluded") & F.col("offset")).alias("held"))
    active = outlets.filter("not excluded and not offset")
    near = second_neighbours(active, keys)
    dup = active.groupBy(*keys, text.spot_key(F.col("name"), F.col("latitude"), F.col("longitude")).alias("_k")).agg(
        F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.sum(F.col("_n") - 1).alias("duplicates"))
    mix = frequency_mix(active, keys).drop("outlets", "monthly_visits")
    near = cut(near)
    out = (status.join(market_shape(near, keys), keys).join(mix, keys).join(workload_model(near, keys, wd), keys)
           .join(dup, keys).withColumn("country", guess_country(F.col("centre_lat"), F.col("centre_lng"))))
    out = out.withColumn("week", week_of_country(F.col("country"))).withColumn("week_label", week_label(F.col("week")))
    calls = F.col("sustainable_calls")
    low, high = F.greatest(F.lit(6), F.floor(calls * 0.85 + 0.5)).cast("int"), F.greatest(F.lit(8), F.least(F.lit(45), calls))
    source = F.lit("workload")
    if saved is not None:
        s = saved.select(*keys, F.col("country").alias("_country"), F.col("low").alias("_low"), F.col("high").alias("_high"))
        out = out.join(s, keys, "left")
        same = F.col("_low").isNotNull() & (F.col("_country").isNull() | F.col("country").isNull() | (F.col("_country") == F.col("country")))
        low, high = F.when(same, F.col("_low")).otherwise(low), F.when(same, F.col("_high")).otherwise(high)
        source = F.when(same, "your last plan").otherwise(source)
    if choice.get("low") and choice.get("high"):
        low, high, source = F.lit(min(choice["low"], choice["high"])), F.lit(max(choice["low"], choice["high"])), F.lit("your choice")
    hop = F.lit(float(choice["hop_km"])) if choice.get("hop_km") else F.when(F.col("nn3_p75") > 1.5, 8.0).otherwise(4.0)
    out = (out.withColumn("band_low", low).withColumn("band_high", high).withColumn("band_source", source)
           .withColumn("hop_km", hop).withColumn("slots", F.size("week") * 4))
    if choice.get("balance_by"):
        out = out.withColumn("balance_by", F.lit(choice["balance_by"]))
    out = choose_headcount(out, "monthly_visits", "slots", "band_low", "band_high")
    per_call = F.col("call_min") + F.col("travel_min")
    reps = headcount_for_shift(F.col("headcount.reps"), F.col("monthly_visits"), F.col("slots"), per_call, F.col("band_low"), wd)
    out = out.withColumn("reps", reps)
    per_day = F.col("monthly_visits") / (F.col("reps") * F.col("slots"))
    check = lambda id_, status_: F.struct(F.lit(id_).alias("id"), status_.alias("status"))
    warn = lambda cond: F.when(cond, "warn").otherwise("pass")
    checks = F.array(check("outlets", F.lit("pass")), check("held", warn(F.col("held") > 0)),
                     check("duplicates", warn(F.col("duplicates") > 0)),
                     check("band", warn(~((per_day >= F.col("band_low")) & (per_day <= F.col("band_high"))))))
    return (out.withColumn("visits_per_day", half_up(per_day, 1))
            .withColumn("day_hours", half_up((per_day * per_call + F.lit(wd.commute + wd.pause)) / 60, 1))
            .withColumn("checks", checks).drop("_country", "_low", "_high"))


def room_below(mean: Column, low: Column, high: Column, at_least: float = 0.0) -> Column:
    """How far days may sit under the mean, as a share: what the floor leaves (at most 35%), 10% where it is out of reach."""
    room = F.least(F.lit(0.35), F.greatest(F.lit(at_least), (mean - low) / mean))
    ten = F.lit(max(at_least, 0.10))
    return F.when(low > mean, ten).otherwise(F.when(high < mean, F.least(room, ten)).otherwise(room))


def room_above(mean: Column, low: Column, high: Column, at_least: float = 0.0) -> Column:
    room = F.least(F.lit(0.35), F.greatest(F.lit(at_least), (high - mean) / mean))
    ten = F.lit(max(at_least, 0.10))
    return F.when(high < mean, ten).otherwise(F.when(low > mean, F.least(room, ten)).otherwise(room))


def territory_room(mean: Column, low: Column, high: Column, cycle_days: Column) -> Column:
    """STRUCT(below, above): room of a territory's month around the mean, between 0.5% and 2.5% a side."""
    clamp = lambda x: F.least(F.lit(0.025), F.greatest(F.lit(0.005), x))
    return F.struct(clamp((mean - low * cycle_days) / mean).alias("below"), clamp((high * cycle_days - mean) / mean).alias("above"))


def zone_sizing(visits: Column, outlets: Column, low: Column, high: Column, repeats: Column) -> Column:
    """STRUCT(share, min_outlets, max_outlets): outlets a zone needs so its visits due a run fill the band."""
    share = F.least(F.lit(1.0), F.greatest(1.0 / repeats, visits / repeats / outlets))
    fewest = F.greatest(F.lit(1), F.floor(low / share + 0.5)).cast("int")
    most = F.greatest(fewest + 1, F.floor(high / share + 0.5).cast("int"))
    return F.struct(share.alias("share"), fewest.alias("min_outlets"), most.cast("int").alias("max_outlets"))


def capacity_warning(visits: Column, reps: Column, slots: Column, repeats: Column, low: Column) -> Column:
    """STRUCT(visits_per_day, supported_days) where the month cannot fill the floor, else null."""
    per_day = visits / (reps * slots)
    days = F.greatest(F.lit(1), F.floor(visits / (reps * repeats * low))).cast("int")
    return F.when(per_day < low, F.struct(half_up(per_day, 1).alias("visits_per_day"), days.alias("supported_days")))


def suggested_reps(outlets: DataFrame, keys: list[str], low: int = 6, high: int = 12) -> DataFrame:
    """Team size from visits and geographic spread: up to 30% fewer visits a day where outlets lie far apart."""
    span = outlets.groupBy(*keys).agg(
        F.min("latitude").alias("_a"), F.max("latitude").alias("_b"), F.min("longitude").alias("_x"), F.max("longitude").alias("_y"),
        F.sum(F.when(F.col("vf") > 0, F.col("vf")).otherwise(2)).alias("visits"), F.count(F.lit(1)).alias("outlets"))
    spread = haversine_km(F.col("_a"), F.col("_x"), F.col("_b"), F.col("_y"))
    per_week = (low + high) / 2 * (1 - F.least(F.lit(0.3), F.col("spread_km") / 50)) * 5
    need = F.ceil(F.ceil(F.col("visits") / per_week) / 0.85)
    return span.withColumn("spread_km", spread).select(*keys, "visits", "outlets", "spread_km", F.greatest(
        F.lit(1), F.least(need, F.ceil(F.col("outlets") / 3))).cast("int").alias("reps"))


def time_band(outlets: DataFrame, keys: list[str], hours: float, max_minutes: float) -> DataFrame:
    """Visits a day from working hours: mean call (capped) plus 10 minutes of travel; the floor is 80%."""
    per = F.least(F.avg(F.coalesce("time_per_visit", F.lit(30))), F.lit(max_minutes)) + 10
    return outlets.groupBy(*keys).agg(F.floor(F.lit(hours * 60) / per).cast("int").alias("max_visits")).withColumn(
        "min_visits", F.greatest(F.lit(1), F.floor(F.col("max_visits") * 0.8)).cast("int"))
