"""Cutting a map into balanced groups, and moving border outlets between groups in rounds.

Groups are cut along a space-filling curve or by straight lines. All later moves work on one
neighbour list per outlet (its k nearest, found once): a round joins it with the current groups,
picks moves that cannot conflict (a group gives to one group and takes from one group), checks them
against the band and applies them. Every group of every market takes part in a round.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from beatwise.functions.geo import RAD, haversine_km, hilbert_d, local_x_km, local_y_km
from beatwise.operators import moves as mv
from beatwise.operators.neighbours import components, nearest
from beatwise.operators.prefix import running_total
from beatwise.params import EARTH_KM, KM_PER_LAT, KM_PER_LNG
from beatwise.session import cut

c = F.col
SIDE = 1 << 16
#: Strips per direction in which a straight cut adds up loads.
STRIPS = 1024
#: Outlets of a key up to which one task finds all its straight cuts; larger keys are added up by strips.
LINE_ROWS = 8192


def curve_position(points: DataFrame, keys: list[str], flipped: bool = False) -> DataFrame:
    """Add ``d``, the place along a Hilbert curve over the square that bounds the key's points."""
    box = points.groupBy(*keys).agg(F.min("latitude").alias("_a"), F.max("latitude").alias("_b"),
                                    F.min("longitude").alias("_x"), F.max("longitude").alias("_y"))
    per_lng = F.lit(KM_PER_LNG) * F.cos(F.radians((c("_a") + c("_b")) / 2))
    span = F.greatest((c("_y") - c("_x")) * per_lng, (c("_b") - c("_a")) * KM_PER_LAT, F.lit(1e-9))
    at = lambda km: F.least(F.lit(SIDE - 1), F.floor(km / span * (SIDE - 1)))
    x, y = at((c("longitude") - c("_x")) * per_lng), at((c("latitude") - c("_a")) * KM_PER_LAT)
    return points.join(box, keys).withColumn("d", hilbert_d(*((y, x) if flipped else (x, y)))).drop("_a", "_b", "_x", "_y")


def capacity_runs(ordered: DataFrame, keys: list[str], k: Column, weight: str = "weight", order: str = "d",
                  id_col: str = "outlet_id") -> DataFrame:
    """Cut an order into k runs of equal load (``group`` from 0): an outlet belongs where its middle falls."""
    cum = running_total(ordered, keys, F.floor(c(order) / 65536), [order, id_col], c(weight).cast("double"), "_cum", total="_tot")
    middle = c("_cum") - c(weight) / 2
    g = F.greatest(F.lit(0), F.least(k - 1, F.ceil(middle * k / c("_tot") - 1e-9) - 1))
    return cum.withColumn("group", g.cast("int")).drop("_cum", "_tot")


def hilbert_partition(points: DataFrame, keys: list[str], k: Column, weight: str = "weight", id_col: str = "outlet_id",
                      flipped: bool = False) -> DataFrame:
    """k contiguous groups of equal load per key; a running sum over curve chunks, so one key may be any size."""
    return capacity_runs(curve_position(points, keys, flipped), keys, k, weight, "d", id_col)


def _straight_cut(ids: np.ndarray, px: np.ndarray, py: np.ndarray, w: np.ndarray, k: int, lo: float, hi: float, turns: np.ndarray) -> np.ndarray | None:
    """Which outlets (in the order of their ids) lie left of the best straight cut of ``line_split``; None where there is none."""
    n, k1 = len(ids), k // 2
    k2, goal = k - k1, w.sum() * k1 / k
    proj = px * turns[:, :1] + py * turns[:, 1:]
    order = np.argsort(proj, axis=1, kind="stable")
    at = np.take_along_axis(proj, order, 1)
    span = at[:, -1:] - at[:, :1]
    strip = np.clip(np.floor((at - at[:, :1]) / np.where(span > 0, span, 1.0) * STRIPS), 0, STRIPS - 1)
    load, sx, sy, ss = (np.cumsum(v[order], axis=1) for v in (w, px, py, px ** 2 + py ** 2))
    balance = np.take_along_axis(strip, (load >= goal).argmax(axis=1)[:, None], 1)
    pos, gap, border = np.arange(1, n), np.diff(at, axis=1), strip[:, 1:] != strip[:, :-1]
    open_ = (border | (strip[:, 1:] == balance) & (goal > 0)) & (pos >= k1) & (n - pos >= k2)
    if not open_.any():
        return None
    upto, sx, sy, all_, ss = load[:, :-1], sx[:, :-1], sy[:, :-1], ss[:, -1:], ss[:, :-1]
    slack = lambda parts: min(w.max(), (hi - lo) * parts / 4) if parts > 1 else 0.0
    room = lambda x, parts: (x >= parts * lo + slack(parts)) & (x <= parts * hi - slack(parts))
    fit = open_ & room(upto, k1) & room(w.sum() - upto, k2)
    side = lambda q: np.sqrt(np.maximum(0.0, q) * math.pi)
    bend = sx ** 2 + sy ** 2
    tour = np.round(0.7124 * (side(ss - bend / pos) + side(all_ - ss - bend / (n - pos))), 9)
    off = np.round(np.abs(upto - goal), 9)
    option = lambda d, p: (tour[d, p], d, at[d, p], (1 << 63) - 1 if border[d, p] else int(ids[order[d, p]]))
    some = np.flatnonzero(fit.any(axis=1))
    if len(some):
        widest = np.where(fit, np.round(gap, 9), -np.inf).argmax(axis=1)
        nearest_ = np.where(fit, off, np.inf).argmin(axis=1)
        best = min(option(d, p[d]) for d in some for p in (widest, nearest_))
    else:
        off = np.where(open_, off, np.inf)
        best = min(option(d, p) for d, p in np.argwhere(off == off.min()))
    _, d, to, last = best
    return (proj[d] < to) | (proj[d] == to) & (ids <= last)


#: What the cuts need of an outlet, in one column.
LINE_ROW = ["id", "la", "lo", "w", "x", "y"]


def _line_row(id_col: str, weight: str) -> Column:
    # Outlets on one spot are told apart by a millimetre.
    off = lambda seed: (F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 20)) / (1 << 20) - 0.5) * 2e-6
    return F.struct(c(id_col).cast("bigint").alias("id"), c("latitude").cast("double").alias("la"), c("longitude").cast("double").alias("lo"),
                    c(weight).cast("double").alias("w"), off(1).alias("x"), off(2).alias("y"))


def _few_rows(id_col: str, weight: str) -> Column:
    """Whether a group is of up to LINE_ROWS outlets with known figures, for one task to cut."""
    known = [F.count(x) for x in (id_col, "latitude", "longitude", weight)]
    return ((F.greatest(*known, F.count(F.lit(1))) == F.least(*known)) & (F.count(F.lit(1)) <= LINE_ROWS) & (F.min(weight) >= 0)
            & ~F.isnan(F.sum(c("latitude") + c("longitude") + c(weight))))


def _turns(directions: int) -> np.ndarray:
    return np.array([(math.cos(math.pi * i / directions), math.sin(math.pi * i / directions)) for i in range(directions)])


def _line_parts(figures: list[np.ndarray], at: np.ndarray, k: int, low: float, high: float, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All levels of ``line_split`` for the outlets ``at`` of one key: their places, by id, and parts."""
    ids, la, lo, w, x, y = figures
    at = at[np.argsort(ids[at], kind="stable")]
    node, parts = np.zeros(len(at), "int32"), np.full(len(at), k, "int32")
    repeated = len(np.unique(ids[at])) < len(at)
    while True:
        left = np.full(len(at), -1)
        for name in np.unique(node[parts > 1]):
            here = np.flatnonzero((node == name) & (parts > 1))
            i = at[here]
            mid = la[i].mean()
            px = (lo[i] - lo[i].mean()) * KM_PER_LNG * math.cos(mid * RAD) + x[i]
            found = _straight_cut(ids[i], px, (la[i] - mid) * KM_PER_LAT + y[i], w[i], int(parts[here].max()), low, high, turns)
            if found is not None:
                left[here] = found
        if (left < 0).all():
            return at, node
        if repeated:
            # Rows of one id go with each of its sides, as in a join.
            sides = pd.DataFrame({"id": ids[at], "left": left})
            both = sides[["id"]].assign(row=np.arange(len(at))).merge(sides[left >= 0], on="id", how="left")
            at, node, parts, left = at[both["row"]], node[both["row"]], parts[both["row"]], both["left"].fillna(-1).to_numpy()
        half = parts // 2
        node = np.where(left == 0, node + half, node).astype("int32")
        parts = np.where(left < 0, parts, np.where(left == 1, half, parts - half)).astype("int32")


def _row_figures(table: pa.Table) -> list[np.ndarray]:
    row = table.column("_row").combine_chunks()
    return [row.field(i).to_numpy(zero_copy_only=False) for i in range(len(LINE_ROW))]


def _parts_of_key(directions: int):
    """The outlets of a key with their part."""
    turns = _turns(directions)

    def run(table: pa.Table) -> pa.Table:
        k, low, high = (table.column(x)[0].as_py() for x in ("_k", "_lo", "_hi"))
        at, node = _line_parts(_row_figures(table), np.arange(table.num_rows), k, low, high, turns)
        return table.drop_columns(["_row", "_k", "_lo", "_hi"]).take(pa.array(at)).append_column("part", pa.array(node, pa.int32()))

    return run


def _radius_km(la: np.ndarray, lo: np.ndarray) -> float:
    """Greatest distance to the centre."""
    a, b = np.radians(la), np.radians(la.mean())
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lo.mean() - lo) / 2) ** 2
    return float((2 * EARTH_KM * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0.0, 1 - h)))).max())


def _paths_of_zone(max_radius_km: float, directions: int = 36):
    """The outlets of a zone cut in two by lines until each part fits: ``_path`` goes on with the side taken at each cut."""
    turns = _turns(directions)

    def run(table: pa.Table) -> pa.Table:
        figures = _row_figures(table)
        la, lo = figures[1:3]
        start = table.column("_path")[0].as_py()
        open_, places, paths = [(np.arange(table.num_rows), start)], [], []
        while open_:
            at, path = open_.pop()
            parts = None
            if len(at) > 1 and _radius_km(la[at], lo[at]) > max_radius_km:
                at, parts = _line_parts(figures, at, 2, -1e-9, len(at) + 1e-9, turns)
            if parts is None or not parts.any():
                places.append(at)
                paths += [path] * len(at)
            else:
                open_ += [(at[parts == side], f"{path}{side}") for side in (0, 1)]
        out = table.drop_columns(["_row", "_path"]).take(pa.array(np.concatenate(places)))
        return out.append_column("_path", pa.array(paths, pa.string()))

    return run


def line_split(points: DataFrame, keys: list[str], k: Column | int, weight: str = "weight", below: float | str = 0.1, above: float | str = 0.1,
               id_col: str = "outlet_id", directions: int = 36) -> DataFrame:
    """Split each key into k parts by straight cuts, level by level for all keys at once (``part`` from 0).

    A level tries every direction; among cuts that keep both sides inside the band it weighs the
    widest gap and the nearest balance by the tour length the two sides' spread implies. Where no
    cut fits, the nearest balance is taken. ``k`` may be a column that is constant per key, and the
    band may name such columns.

    A cut falls between two strips of a direction, or between two outlets of the one strip in which the loads balance.
    Keys of up to LINE_ROWS outlets are cut by ``_line_parts``, all levels in one task. For larger ones loads are
    added up per direction and strip (a histogram, built before the shuffle), so a key of any size is a few thousand
    rows to a task; only the balancing strip's outlets are lined up.
    """
    k = k if isinstance(k, Column) else F.lit(k)
    wide = lambda x: c(x) if isinstance(x, str) else F.lit(x)
    total = points.groupBy(*keys).agg(F.max(k).cast("int").alias("_k"), F.sum(weight).alias("_sum"), F.max(wide(below)).alias("_b"), F.max(wide(above)).alias("_a"),
                                      _few_rows(id_col, weight).alias("_small"))
    unit = c("_sum") / F.greatest(F.lit(1), c("_k"))
    total = cut(total.select(*keys, "_k", (unit * (1 - c("_b")) - 1e-9).alias("_lo"), (unit * (1 + c("_a")) + 1e-9).alias("_hi"), "_small"))
    most = total.filter("not _small or _small is null").agg(F.max("_k").alias("k")).first()["k"]
    cols = [*keys, id_col, *[x for x in points.columns if x not in (*keys, id_col)]]
    near = points.join(total.filter("_small").drop("_small"), keys).select(*cols, _line_row(id_col, weight).alias("_row"), "_k", "_lo", "_hi")
    few = near.groupBy(*keys).applyInArrow(_parts_of_key(directions), near.select(*cols, F.lit(0).alias("part")).schema)
    if most is None:
        return few
    total = total.filter("not _small or _small is null").drop("_small")
    cur = points.join(total, keys).withColumn("_node", F.lit(0))
    node, ray = [*keys, "_node"], [*keys, "_node", "_dir"]
    turns = _turns(directions).tolist()
    cosines, sines = (F.array(*[F.lit(t[j]) for t in turns]) for j in (0, 1))
    for level in range(max(0, math.ceil(math.log2(max(1, most))))):
        cur = cut(cur) if level else cur
        mean = cur.filter("_k > 1").groupBy(*node).agg(F.avg("latitude").alias("_la"), F.avg("longitude").alias("_lo0"), F.sum(weight).alias("_tot"),
                                                       F.max(weight).alias("_wmax"), F.count(F.lit(1)).alias("_n"))
        p = cur.filter("_k > 1").join(mean, node)
        p = cut(p.select(*node, id_col, weight, "_k", "_lo", "_hi", "_tot", "_wmax", "_n",
                         (local_x_km(c("longitude") - c("_lo0"), c("_la")) + _line_row(id_col, weight)["x"]).alias("_px"), (local_y_km(c("latitude") - c("_la")) + _line_row(id_col, weight)["y"]).alias("_py")))
        along = lambda i: c("_px") * turns[i][0] + c("_py") * turns[i][1]
        ends = p.groupBy(*node).agg(F.array(*[F.struct(F.min(along(i)).alias("a"), F.max(along(i)).alias("b")) for i in range(directions)]).alias("_ends"))
        rays = p.join(ends, node).withColumn("_t", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(directions - 1)).alias("i"), cosines.alias("c"), sines.alias("s"), c("_ends").alias("e"))))
        rays = rays.withColumn("_dir", c("_t.i")).withColumn("_proj", c("_px") * c("_t.c") + c("_py") * c("_t.s"))
        strip = F.when(c("_t.e.b") > c("_t.e.a"), F.floor((c("_proj") - c("_t.e.a")) / (c("_t.e.b") - c("_t.e.a")) * STRIPS)).otherwise(0)
        rays = rays.withColumn("_strip", F.greatest(F.lit(0), F.least(F.lit(STRIPS - 1), strip)).cast("int")).drop("_t", "_ends")
        whole = [F.max(x).alias(x) for x in ("_k", "_lo", "_hi", "_tot", "_wmax", "_n")]
        sums = [F.sum(x).alias(y) for x, y in ((c(weight), "_w"), (F.lit(1), "_c"), (c("_px"), "_x"), (c("_py"), "_y"), (c("_px") ** 2 + c("_py") ** 2, "_q"))]
        bars = rays.groupBy(*ray, "_strip").agg(*sums, F.min("_proj").alias("_from"), F.max("_proj").alias("_to"), *whole)
        w = Window.partitionBy(*ray).orderBy("_strip")
        upto = lambda x: F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0))
        bars = (bars.withColumn("_gap", F.lead("_from").over(w) - c("_to")).withColumn("_all", F.sum("_q").over(Window.partitionBy(*ray)))
                .withColumns({"_cum": upto("_w"), "_pos": upto("_c"), "_sx": upto("_x"), "_sy": upto("_y"), "_ss": upto("_q")}))
        bars = cut(bars.withColumn("_last", F.lit(2 ** 63 - 1).cast("bigint")))
        k1 = F.floor(c("_k") / 2)
        k2 = c("_k") - k1
        goal = c("_tot") * k1 / c("_k")
        # The strip in which the loads balance, outlet by outlet.
        inner = bars.filter((c("_cum") >= goal) & (c("_cum") - c("_w") < goal) & (c("_c") > 1)).select(
            *ray, "_strip", "_all", *[(c(x) - c(y)).alias(f"{x}0") for x, y in (("_cum", "_w"), ("_pos", "_c"), ("_sx", "_x"), ("_sy", "_y"), ("_ss", "_q"))])
        v = Window.partitionBy(*ray).orderBy("_proj", id_col)
        so_far = lambda x, start: c(start) + F.sum(x).over(v.rowsBetween(Window.unboundedPreceding, 0))
        rows = rays.join(inner, [*ray, "_strip"]).withColumns({
            "_cum": so_far(c(weight), "_cum0"), "_pos": so_far(F.lit(1), "_pos0"), "_sx": so_far(c("_px"), "_sx0"), "_sy": so_far(c("_py"), "_sy0"),
            "_ss": so_far(c("_px") ** 2 + c("_py") ** 2, "_ss0"), "_gap": F.lead("_proj").over(v) - c("_proj")})
        ends = [*ray, "_k", "_lo", "_hi", "_tot", "_wmax", "_n", "_all", "_cum", "_pos", "_sx", "_sy", "_ss", "_gap", "_to", "_last"]
        cuts = bars.select(*ends).unionByName(rows.withColumn("_to", c("_proj")).withColumn("_last", c(id_col).cast("bigint")).select(*ends))
        slack = lambda parts: F.when(parts > 1, F.least(c("_wmax"), (c("_hi") - c("_lo")) * parts / 4)).otherwise(0.0)
        room = lambda load, parts: (load >= parts * c("_lo") + slack(parts)) & (load <= parts * c("_hi") - slack(parts))
        open_ = c("_gap").isNotNull() & (c("_pos") >= k1) & (c("_n") - c("_pos") >= k2)
        spread = lambda ss: F.sqrt(F.greatest(F.lit(0.0), ss) * math.pi)
        ss_left = c("_ss") - (c("_sx") ** 2 + c("_sy") ** 2) / c("_pos")
        ss_right = (c("_all") - c("_ss")) - (c("_sx") ** 2 + c("_sy") ** 2) / (c("_n") - c("_pos"))
        tour = 0.7124 * (spread(ss_left) + spread(ss_right))
        off_goal = F.round(F.abs(c("_cum") - goal), 9)
        option = F.struct(F.round(tour, 9).alias("cost"), c("_dir").alias("dir"), c("_to").alias("to"), c("_last").alias("last"))
        fit = open_ & room(c("_cum"), k1) & room(c("_tot") - c("_cum"), k2)
        per_dir = cuts.filter(open_).groupBy(*ray).agg(
            F.max(F.when(fit, F.struct(F.round("_gap", 9).alias("g"), (-c("_pos")).alias("p"), option.alias("o")))).alias("_wide"),
            F.min(F.when(fit, F.struct(off_goal.alias("f"), c("_pos").alias("p"), option.alias("o")))).alias("_near"),
            F.min(F.struct(off_goal.alias("f"), option.alias("o"))).alias("_any"))
        best = per_dir.groupBy(*node).agg(F.least(F.min("_wide.o"), F.min("_near.o")).alias("_b"), F.min("_any").alias("_a"))
        best = best.select(*node, F.coalesce("_b", c("_a.o")).alias("_b"))
        at = c("_px") * F.element_at(cosines, c("_b.dir") + 1) + c("_py") * F.element_at(sines, c("_b.dir") + 1)
        left = F.struct(at.alias("p"), c(id_col).cast("bigint").alias("i")) <= F.struct(c("_b.to").alias("p"), c("_b.last").alias("i"))
        side = p.join(best, node).select(*keys, id_col, left.alias("_left"))
        cur = cur.join(side, [*keys, id_col], "left")
        half = F.floor(c("_k") / 2).cast("int")
        cur = (cur.withColumn("_node", F.when(c("_left").isNull() | c("_left"), c("_node")).otherwise(c("_node") + half).cast("int"))
               .withColumn("_k", F.when(c("_left").isNull(), c("_k")).when(c("_left"), half).otherwise(c("_k") - half).cast("int"))
               .drop("_left"))
    return cur.withColumnRenamed("_node", "part").select(*cols, "part").unionByName(few)


# ------------------------------------------------------------------ moves between groups

def neighbour_graph(points: DataFrame, keys: list[str], k: int = 8, id_col: str = "outlet_id") -> DataFrame:
    """The k nearest of every outlet: keys, outlet_id, nbr_id, km. Found once per partition job."""
    return cut(nearest(points, points, keys, k, id_col, id_col).select(*keys, c(id_col).alias("outlet_id"), "nbr_id", "km"))


def _loads(state: DataFrame, keys: list[str], below: float | str, above: float | str) -> DataFrame:
    """Load of every group with its key's mean and band; a band may name columns that are constant per key."""
    wide = lambda x: c(x) if isinstance(x, str) else F.lit(x)
    g = state.groupBy(*keys, "group").agg(F.sum("weight").alias("load"), F.max(wide(below)).alias("_b"), F.max(wide(above)).alias("_a"))
    m = g.groupBy(*keys).agg((F.sum("load") / F.count(F.lit(1))).alias("mean"))
    return g.join(m, keys).withColumn("lo", c("mean") * (1 - c("_b"))).withColumn("hi", c("mean") * (1 + c("_a"))).drop("_a", "_b")


def _touching(state: DataFrame, graph: DataFrame, keys: list[str]) -> DataFrame:
    """Outlets with each group among their neighbours: outlet_id, g (own), h (other or own), km to its nearest member.
    Joins of outlets are shuffle joins here and below: broadcast in every round, they would go through the driver each time."""
    other = state.select(*keys, c("outlet_id").alias("nbr_id"), c("group").alias("h"))
    own = state.select(*keys, "outlet_id", c("group").alias("g"), "weight")
    return (graph.join(other.hint("shuffle_hash"), [*keys, "nbr_id"]).groupBy(*keys, "outlet_id", "h").agg(F.min("km").alias("km"))
            .join(own.hint("shuffle_hash"), [*keys, "outlet_id"]))


def _with_loads(cands: DataFrame, loads: DataFrame, keys: list[str]) -> DataFrame:
    give = loads.select(*keys, c("group").alias("g"), c("load").alias("g_load"), "mean", "lo", "hi")
    take = loads.select(*keys, c("group").alias("h"), c("load").alias("h_load"))
    return cands.join(give, [*keys, "g"]).join(take, [*keys, "h"])


def one_to_one(cands: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """Keep, of candidate moves g -> h (lower score first), the pairs that are best for both their groups,
    so no group gives twice, takes twice or does both in one round."""
    pair = cands.groupBy(*keys, "g", "h").agg(F.min(F.struct(score.alias("s"), c("outlet_id").alias("o"))).alias("_s"))
    ranked = pair.withColumn("_e", F.explode(F.array("g", "h")))
    best = ranked.groupBy(*keys, c("_e").alias("_group")).agg(F.min(F.struct(c("_s"), c("g"), c("h"))).alias("_b"))
    chosen = best.groupBy(*keys, c("_b.g").alias("g"), c("_b.h").alias("h")).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 2")
    return cands.join(chosen.select(*keys, "g", "h"), [*keys, "g", "h"])


def _moved(state: DataFrame, moves: DataFrame, keys: list[str]) -> DataFrame:
    m = moves.select(*keys, "outlet_id", c("h").alias("_to"))
    return cut(state.join(m, [*keys, "outlet_id"], "left").withColumn("group", F.coalesce("_to", "group")).drop("_to"))


def _rounds(state: DataFrame, keys: list[str], rounds: int | None, step, graph: DataFrame, few, once: bool = False, figures: DataFrame | None = None) -> DataFrame:
    """Rounds of moves until no key has one (or ``rounds``). A key without a move has settled and leaves the
    loop; the others carry on. With ``once`` an outlet moves once at most: ``step`` gets those that did.

    Keys that a task can hold go through all their rounds there by ``few``, the same step on arrays; ``figures``
    (keys, outlet_id, ...) are what it needs besides the state."""
    cols = state.columns
    state = cut(state)
    more = [] if figures is None else [x for x in figures.columns if x not in (*keys, "outlet_id")]
    told = state if figures is None else cut(state.join(figures, [*keys, "outlet_id"], "left"))
    small, others = mv.by_size(told, keys, *more)
    if not others:
        return mv.settled(told, graph, keys, rounds, few, once, cols)
    moved = mv.settled(told.join(small, keys, "left_semi"), graph, keys, rounds, few, once, cols)
    return moved.unionByName(_joined_rounds(state.join(small, keys, "left_anti"), keys, rounds, step, once))


def _joined_rounds(state: DataFrame, keys: list[str], rounds: int | None, step, once: bool) -> DataFrame:
    cols = state.columns
    live, settled, done = cut(state.withColumn("_spent", F.lit(False))), None, 0
    while rounds is None or done < rounds:
        now = live.select(*cols)
        moves = step(now, live.filter("_spent").select(*keys, "outlet_id") if done else None) if once else step(now)
        seen = Observation()
        nxt = cut(live.join(moves.select(*keys, "outlet_id", c("h").alias("_to")).hint("shuffle_hash"), [*keys, "outlet_id"], "left").observe(seen, F.count("_to").alias("moves")))
        if not seen.get["moves"]:
            break
        done += 1
        live = nxt.withColumn("group", F.coalesce("_to", "group")).withColumn("_spent", c("_spent") | c("_to").isNotNull()).select(*cols, "_spent")
        # A key that had no move never has one again. They are set aside in rounds 1, 2, 4, 8 and so on, so the parts stay few.
        if done & (done - 1) == 0:
            busy = nxt.filter("_to is not null").select(*keys).distinct()
            rest = live.join(busy, keys, "left_anti").select(*cols)
            settled = rest if settled is None else settled.unionByName(rest)
            live = live.join(busy, keys, "left_semi")
    live = live.select(*cols)
    return live if settled is None else settled.unionByName(live)


def _unspent(cands: DataFrame, spent: DataFrame | None, keys: list[str]) -> DataFrame:
    return cands if spent is None else cands.join(spent.hint("shuffle_hash"), [*keys, "outlet_id"], "left_anti")


def repair_loads(state: DataFrame, graph: DataFrame, keys: list[str], below: float | str = 0.1, above: float | str = 0.1,
                 hop_km: float = 4.0, rounds: int | None = None) -> DataFrame:
    """Move border outlets from groups over the band (or over the mean beside one under it) to groups with
    room, nearest border first, never over the hop. ``state``: keys, outlet_id, group, weight.

    A move always goes from the heavier of two groups to the lighter and leaves it lighter, and a group is
    in one exchange a round, so the squares of the loads fall and the rounds end by themselves."""
    def step(s):
        d = _with_loads(_touching(s, graph, keys).filter("g <> h").filter(c("km") <= hop_km), _loads(s, keys, below, above), keys)
        need = (c("g_load") > c("hi")) & (c("h_load") < c("mean")) | (c("h_load") < c("lo")) & (c("g_load") > c("mean"))
        d = d.filter(need & (c("g_load") - c("weight") >= c("lo")) & (c("h_load") + c("weight") <= c("hi")))
        d = one_to_one(d, keys, c("km"))
        w = Window.partitionBy(*keys, "g", "h").orderBy("km", "outlet_id").rowsBetween(Window.unboundedPreceding, 0)
        sent = F.sum("weight").over(w)
        return d.withColumn("_sent", sent).filter((c("_sent") <= F.greatest(c("weight"), F.least(c("g_load") - c("mean"), c("mean") - c("h_load"))))
                                                  & (c("g_load") - c("_sent") >= c("lo")) & (c("h_load") + c("_sent") <= c("hi")))
    return _rounds(state, keys, rounds, step, graph, mv.repair(below, above, hop_km))


def cohesion_moves(state: DataFrame, graph: DataFrame, keys: list[str], below: float | str = 0.1, above: float | str = 0.1,
                   ratio: float = 0.8, rounds: int | None = None) -> DataFrame:
    """Move outlets whose nearest neighbour of another group is under ``ratio`` of the nearest of their own, in the
    band. Two groups exchange as many a round as the band allows, and an outlet moves once at most, so the rounds end."""
    far = cut(graph.groupBy(*keys, "outlet_id").agg(F.max("km").alias("_far")))

    def step(s, spent):
        t = _touching(s, graph, keys)
        own = t.filter("g = h").select(*keys, "outlet_id", c("km").alias("own_km"))
        d = _unspent(t.filter("g <> h"), spent, keys).join(own.hint("shuffle_hash"), [*keys, "outlet_id"], "left").join(far.hint("shuffle_hash"), [*keys, "outlet_id"]).withColumn("own_km", F.coalesce("own_km", "_far"))
        d = _with_loads(d.filter(c("km") < ratio * c("own_km")), _loads(s, keys, below, above), keys)
        d = d.filter((c("g_load") - c("weight") >= c("lo")) & (c("h_load") + c("weight") <= c("hi")))
        d = one_to_one(d, keys, c("km") - c("own_km"))
        w = Window.partitionBy(*keys, "g", "h").orderBy(c("km") - c("own_km"), "outlet_id").rowsBetween(Window.unboundedPreceding, 0)
        return d.withColumn("_sent", F.sum("weight").over(w)).filter((c("g_load") - c("_sent") >= c("lo")) & (c("h_load") + c("_sent") <= c("hi")))
    return _rounds(state, keys, rounds, step, graph, mv.cohesion(below, above, ratio), once=True)


def compact_swaps(state: DataFrame, points: DataFrame, graph: DataFrame, keys: list[str], rounds: int | None = None) -> DataFrame:
    """Swap outlets of equal weight between touching groups when both centres gain, each outlet once at most.

    Two groups swap as many outlets a round as gain: those of either side are lined up by gain and swapped place by place."""
    pos = cut(points.select(*keys, "outlet_id", "latitude", "longitude"))

    def step(s, spent):
        at = s.join(pos.hint("shuffle_hash"), [*keys, "outlet_id"])
        mid = at.groupBy(*keys, "group").agg(F.avg("latitude").alias("_la"), F.avg("longitude").alias("_lo"))
        t = _unspent(_touching(s, graph, keys).filter("g <> h"), spent, keys).join(pos.hint("shuffle_hash"), [*keys, "outlet_id"])
        m = lambda name: mid.select(*keys, c("group").alias(name), c("_la").alias(f"la_{name}"), c("_lo").alias(f"lo_{name}"))
        t = t.join(m("g"), [*keys, "g"]).join(m("h"), [*keys, "h"]).withColumn(
            "gain", haversine_km(c("latitude"), c("longitude"), c("la_g"), c("lo_g")) - haversine_km(c("latitude"), c("longitude"), c("la_h"), c("lo_h")))
        line = Window.partitionBy(*keys, "g", "h", "weight").orderBy(F.desc("gain"), "outlet_id")
        t = cut(t.select(*keys, "outlet_id", "g", "h", "weight", "gain").withColumn("_place", F.row_number().over(line)))
        a = t.filter("g < h").withColumnRenamed("gain", "_a")
        b = t.filter("g > h").select(*keys, c("h").alias("g"), c("g").alias("h"), "weight", "_place", c("outlet_id").alias("_back"), c("gain").alias("_b"))
        both = a.join(b, [*keys, "g", "h", "weight", "_place"]).withColumn("gain", c("_a") + c("_b")).filter("gain > 1e-6")
        go = one_to_one(both, keys, -c("gain"))
        return go.select(*keys, F.explode(F.array(F.struct(c("outlet_id"), c("h")), F.struct(c("_back").alias("outlet_id"), c("g").alias("h")))).alias("x")).select(*keys, "x.*")
    return _rounds(state, keys, rounds, step, graph, mv.swaps, once=True, figures=pos)


def hand_over_strays(state: DataFrame, graph: DataFrame, keys: list[str], below: float | str = 0.1, above: float | str = 0.1,
                     rounds: int | None = None) -> DataFrame:
    """Pass outlets most of whose neighbours are another group's to that group, biggest majority first, in the band.
    An outlet is passed on once at most, so the rounds end."""
    from beatwise.operators.spots import stray_votes

    def step(s, spent):
        v = _unspent(stray_votes(graph, s, keys, "group"), spent, keys).select(*keys, "outlet_id", c("from_group").alias("g"), c("to_group").alias("h"), "margin")
        d = _with_loads(v.join(s.select(*keys, "outlet_id", "weight"), [*keys, "outlet_id"]), _loads(s, keys, below, above), keys)
        line = lambda e: F.sum("weight").over(Window.partitionBy(*keys, e).orderBy(F.desc("margin"), "outlet_id").rowsBetween(Window.unboundedPreceding, 0))
        return d.withColumn("_out", line("g")).withColumn("_in", line("h")).filter(
            (c("g_load") - c("_out") >= c("lo")) & (c("h_load") + c("_in") <= c("hi")))
    return _rounds(state, keys, rounds, step, graph, mv.strays(below, above), once=True)


#: Cells on a side of the grid on whose cells centres are first moved.
START_CELLS = 128
#: Sweeps over the prices of the groups of a key; they end as soon as none changes.
SWEEPS = 400


def _km(la: np.ndarray, lo: np.ndarray, cla: np.ndarray, clo: np.ndarray) -> np.ndarray:
    """Distances of places (rows) to centres (columns)."""
    a, b = np.radians(la)[:, None], np.radians(cla)[None, :]
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(clo[None, :] - lo[:, None]) / 2) ** 2
    return 2 * EARTH_KM * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0.0, 1 - h)))


def _prices(km: np.ndarray, weight: np.ndarray, low: float, high: float, price: np.ndarray) -> np.ndarray:
    """Prices of the groups at which loads keep to the band when every row goes where distance and price are least.

    They are the duals of the cheapest assignment under that band: a group over it asks more, one under it less
    than nothing, one inside it nothing. Each is set for the others' prices in turn until none changes.
    """
    price, k = price.copy(), km.shape[1]
    for _ in range(SWEEPS if k > 1 else 0):
        before = price.copy()
        for g in range(k):
            # A row comes as long as the price is below this.
            worth = (np.delete(km, g, 1) + np.delete(price, g)).min(axis=1) - km[:, g]
            free = weight[worth > 0].sum()
            if low - 1e-9 <= free <= high + 1e-9:
                price[g] = 0.0
                continue
            order = np.argsort(-worth, kind="stable")
            load, at = np.cumsum(weight[order]), worth[order]
            n = np.searchsorted(load, high + 1e-9, "right") if free > high else min(len(at), np.searchsorted(load, low - 1e-9) + 1)
            between = at[0] + 1e-3 if n == 0 else at[-1] - 1e-3 if n == len(at) else (at[n - 1] + at[n]) / 2
            price[g] = max(0.0, between) if free > high else min(0.0, between)
        if np.abs(price - before).max() < 1e-7:
            break
    return price


#: What a task gets and gives back of a key's centres: their places, prices and the band.
CENTRES = ["la", "lo", "price"]


def _centres(table: pa.Table) -> tuple[list[np.ndarray], float, float]:
    return [np.array(table.column(x)[0].as_py(), float) for x in CENTRES], table.column("_lo")[0].as_py(), table.column("_hi")[0].as_py()


def _with_centres(table: pa.Table, names: list[str], centres: list[np.ndarray]) -> pa.Table:
    return table.select(names).slice(0, 1).append_column("la", pa.array([centres[0].tolist()])).append_column("lo", pa.array([centres[1].tolist()])).append_column(
        "price", pa.array([centres[2].tolist()]))


def _moved_on_cells(names: list[str]):
    """Centres of a key after assigning and moving them on its cells as long as the distance falls."""
    def run(table: pa.Table) -> pa.Table:
        (cla, clo, price), low, high = _centres(table)
        la, lo, n, w = (table.column(x).to_numpy() for x in ("_cla", "_clo", "_n", "_w"))
        best, kept = np.inf, [cla, clo, price]
        while True:
            km = _km(la, lo, cla, clo)
            price = _prices(km, w, low, high, price)
            own = (km + price).argmin(axis=1)
            cost = float((w * km[np.arange(len(w)), own]).sum())
            if not cost < best - 1e-6:
                return _with_centres(table, names, kept)
            best, kept = cost, [cla, clo, price]
            size = np.bincount(own, n, len(cla))
            mean = lambda x, old: np.where(size > 0, np.bincount(own, n * x, len(old)) / np.maximum(size, 1), old)
            cla, clo = mean(la, cla), mean(lo, clo)
    return run


def _priced(names: list[str]):
    """Centres of a key with the prices that rows near a border, and the loads that are settled, call for."""
    def run(table: pa.Table) -> pa.Table:
        (cla, clo, price), low, high = _centres(table)
        km = table.column("_km").combine_chunks().flatten().to_numpy().reshape(-1, len(cla))
        return _with_centres(table, names, [cla, clo, _prices(km, table.column("_w").to_numpy(), low, high, price)])
    return run


def balanced_kmeans(points: DataFrame, keys: list[str], k: Column, weight: str = "weight", below: float = 0.1, above: float = 0.1,
                    rounds: int | None = None, restarts: int = 2) -> DataFrame:
    """k groups per key near their own centres with loads in the band: keys, outlet_id, weight, group.

    Lloyd's rounds with capacity. Seeds are the farthest points, begun from the outlet farthest out and, in further
    restarts (an extra key), from others. A round gives every outlet of a key to a centre, all at once and at the
    least distance the band allows, and moves the centres to their outlets; a restart ends where its distance no longer falls
    or no centre moves 5 m (or after ``rounds``). The one of least distance is kept.

    The cheapest assignment is that to the least sum of distance and price of a group. Prices are found in one task
    from the outlets near a border and the loads that are settled; no other outlet is moved in a round. Centres
    first move on the cells of a grid, so that few rounds over all outlets are left.
    """
    rk, place = [*keys, "restart"], ["latitude", "longitude"]
    known = [c(x).isNotNull() for x in (*keys, *place)]
    base = points.select(*keys, "outlet_id", *place, c(weight).alias("weight"), k.cast("int").alias("_k"))
    for x in known:
        base = base.filter(x)
    load = F.coalesce(c("weight").cast("double"), F.lit(0.0))
    # Outlets on one spot are told apart by a millimetre.
    off = lambda seed: (F.pmod(F.xxhash64("outlet_id", F.lit(seed)), F.lit(1 << 20)) / (1 << 20) - 0.5) * 2e-8
    base = cut(base.withColumn("_w", load).withColumn("_la", c("latitude") + off(1)).withColumn("_lo0", c("longitude") + off(2)))
    unit = F.sum("_w") / F.greatest(F.lit(1), F.max("_k"))
    total = cut(base.groupBy(*keys).agg(F.max("_k").alias("_k"), (unit * (1 - below)).alias("_lo"), (unit * (1 + above)).alias("_hi"), F.avg("latitude").alias("_mla"), F.avg("longitude").alias("_mlo"),
                                        *[f(x).alias(f"_{n}{i}") for i, x in enumerate(place) for n, f in (("a", F.min), ("b", F.max))]).withColumn("_k", F.greatest(F.lit(1), "_k")))
    most = total.agg(F.max("_k").alias("k")).first()["k"] or 0
    # Seeds: each next one is the outlet farthest from those there are.
    rows = base.select(*keys, "outlet_id", *place)
    first = [F.max(F.struct(F.round(haversine_km(c("latitude"), c("longitude"), c("_mla"), c("_mlo")), 9).alias("d"), *place))]
    first += [F.max(F.struct(F.xxhash64("outlet_id", F.lit(r)).alias("d"), *place)) for r in range(1, restarts)]
    start = rows.join(total.select(*keys, "_mla", "_mlo"), keys).groupBy(*keys).agg(F.array(*[F.struct(*[x[y].alias(y) for y in place]) for x in first]).alias("_s"))
    seeds = cut(start.select(*keys, F.posexplode("_s").alias("restart", "_s")).select(*rk, F.array("_s.latitude").alias("la"), F.array("_s.longitude").alias("lo")).join(
        total.select(*keys, "_k", "_lo", "_hi"), keys))
    for have in range(1, most):
        gap = F.array_min(F.zip_with("la", "lo", lambda a, b: haversine_km(c("latitude"), c("longitude"), a, b)))
        nxt = rows.join(seeds.filter(c("_k") > have).select(*rk, "la", "lo"), keys).groupBy(*rk).agg(F.max(F.struct(F.round(gap, 9).alias("d"), *place)).alias("_s"))
        grown = lambda x, y: F.when(c(f"_s.{y}").isNull(), c(x)).otherwise(F.concat(x, F.array(f"_s.{y}"))).alias(x)
        seeds = cut(seeds.join(nxt, rk, "left").select(*rk, grown("la", "latitude"), grown("lo", "longitude"), "_k", "_lo", "_hi"))
    named = [*rk, "_k", "_lo", "_hi"]
    live = seeds.withColumn("price", F.transform("la", lambda x: F.lit(0.0))).select(*named, *CENTRES)
    step = lambda i: F.least(F.lit(START_CELLS - 1), F.floor((c(place[i]) - c(f"_a{i}")) / F.greatest(c(f"_b{i}") - c(f"_a{i}"), F.lit(1e-9)) * START_CELLS))
    cells = cut(base.join(total.drop("_k", "_lo", "_hi"), keys).groupBy(*keys, step(0).alias("_y"), step(1).alias("_x")).agg(
        F.avg("latitude").alias("_cla"), F.avg("longitude").alias("_clo"), F.count(F.lit(1)).cast("double").alias("_n"), F.sum("_w").alias("_w")))
    on_cells = cells.join(live, keys).select(*live.columns, "_cla", "_clo", "_n", "_w")
    made = ", ".join([*[f"`{x}` {live.schema[x].dataType.simpleString()}" for x in named], *[f"{x} array<double>" for x in CENTRES]])
    live = on_cells.groupBy(*rk).applyInArrow(_moved_on_cells(named), made)
    # An outlet this close to the border between two groups may change them with the prices; it is about two cells.
    width = F.greatest((c("_b0") - c("_a0")) * KM_PER_LAT, (c("_b1") - c("_a1")) * KM_PER_LNG) / START_CELLS * 4 + 0.01
    live = cut(live.join(total.select(*keys, width.alias("_reach")), keys).withColumns({"_cost": F.lit(None).cast("double"), **{f"_was_{x}": c(x) for x in CENTRES}}))
    old = [f"_was_{x}" for x in CENTRES]
    km = F.zip_with("la", "lo", lambda a, b: haversine_km(c("_la0"), c("_lo0"), a, b))
    # Distances to all centres, the group of least distance and price, and by how much it is nearer than the next.
    def scored(now: DataFrame) -> DataFrame:
        s = base.select(*keys, "outlet_id", "weight", "_w", *place, c("_la").alias("_la0"), "_lo0").join(now, keys).withColumn("_km", km)
        s = s.withColumn("_s", F.zip_with("_km", "price", lambda a, b: a + b))
        return s.withColumn("_g", F.array_position("_s", F.array_min("_s")).cast("int") - 1)
    settled, done = None, 0
    while True:
        ask = live.select(*named, *CENTRES, "_reach")
        priced = None
        while not ask.isEmpty():
            s = scored(ask).withColumn("_gap", F.get(F.sort_array("_s"), F.lit(1)) - F.array_min("_s"))
            near = c("_gap") <= c("_reach")
            border = s.filter(near).select(*named, *CENTRES, "_km", "_w")
            sure = s.filter(~F.coalesce(near, F.lit(False))).groupBy(*named, *CENTRES, "_g").agg(F.sum("_w").alias("_w"))
            sure = sure.select(*named, *CENTRES, F.transform("la", lambda x, i: F.when(i == c("_g"), 0.0).otherwise(1e9)).alias("_km"), "_w")
            found = border.unionByName(sure).groupBy(*rk).applyInArrow(_priced(named), made)
            found = found.withColumnRenamed("price", "_new").join(ask.select(*rk, "price", "_reach"), rk)
            turn = F.zip_with("_new", "price", lambda a, b: a - b)
            found = cut(found.withColumn("_ok", F.array_max(turn) - F.array_min(turn) <= c("_reach")).select(*named, "la", "lo", c("_new").alias("price"), "_reach", "_ok"))
            good = found.filter("_ok").select(*rk, "price")
            priced = good if priced is None else priced.unionByName(good)
            # Prices moved further than was looked: again from there, and farther.
            ask = found.filter("not _ok").select(*named, *CENTRES, (c("_reach") * 2).alias("_reach"))
        live = live.drop("price").join(priced, rk)
        at = scored(live.select(*rk, *CENTRES)).groupBy(*rk, "_g").agg(*[F.avg(x).alias(f"_{x}") for x in place], F.sum(c("_w") * F.get("_km", c("_g"))).alias("_sum"))
        at = at.groupBy(*rk).agg(F.map_from_entries(F.collect_list(F.struct("_g", F.struct("_latitude", "_longitude")))).alias("_at"), F.sum("_sum").alias("_now"))
        to = lambda x, y: F.transform(x, lambda old_, i: F.coalesce(F.try_element_at(c("_at"), i)[y], old_))
        now = live.join(at, rk).withColumns({"_nla": to("la", "_latitude"), "_nlo": to("lo", "_longitude")})
        shift = F.array_max(F.zip_with(F.arrays_zip("la", "lo"), F.arrays_zip("_nla", "_nlo"), lambda a, b: haversine_km(a["la"], a["lo"], b["_nla"], b["_nlo"])))
        worse = c("_cost").isNotNull() & (c("_now") >= c("_cost") - 1e-6)
        done += 1
        over = worse | (shift <= 0.005) | F.lit(rounds is not None and done >= rounds)
        now = cut(now.withColumn("_over", over).withColumns({f"_was_{x}": F.when(worse, c(f"_was_{x}")).otherwise(c(x)) for x in CENTRES}).withColumn("_cost", F.when(worse, c("_cost")).otherwise(c("_now"))))
        end = now.filter("_over").select(*rk, *[c(f"_was_{x}").alias(x) for x in CENTRES], "_cost")
        settled = end if settled is None else settled.unionByName(end)
        live = now.filter("not _over").withColumns({"la": c("_nla"), "lo": c("_nlo")}).select(*named, *CENTRES, "_reach", "_cost", *old)
        if live.isEmpty():
            break
    best = settled.groupBy(*keys).agg(F.min(F.struct(F.round("_cost", 6).alias("k"), "restart", *CENTRES)).alias("b")).select(*keys, *[c(f"b.{x}").alias(x) for x in CENTRES])
    return scored(cut(best)).select(*keys, "outlet_id", "weight", c("_g").alias("group"))


def kmeans_zones(points: DataFrame, keys: list[str], k: Column, rounds: int = 4) -> DataFrame:
    """Plain k-means per key from curve seeds: keys, outlet_id, zone_id.

    The nearest centre is found through the grid, so an outlet meets the centres around it only.
    """
    base = points.select(*keys, "outlet_id", "latitude", "longitude", k.alias("_k")).withColumn("weight", F.lit(1.0))
    state = hilbert_partition(base, keys, c("_k")).select(*keys, "outlet_id", "latitude", "longitude", c("group").alias("zone_id"))
    for _ in range(rounds):
        state = cut(state)
        centres = state.groupBy(*keys, "zone_id").agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
        near = nearest(state, centres, keys, 1, "outlet_id", "zone_id", not_self=False, few=True).select(*keys, "outlet_id", c("nbr_id").alias("zone_id"))
        state = state.drop("zone_id").join(near, [*keys, "outlet_id"])
    return state


def choose_k(points: DataFrame, keys: list[str], options: list[int], rounds: int = 1) -> DataFrame:
    """Score cluster counts per key by silhouette 0.4, balance 0.3 and elbow 0.3: keys, k, score, best."""
    from beatwise.operators.zones import silhouette_squared
    rows = None
    for k in options:
        z = cut(kmeans_zones(points, keys, F.lit(k), rounds))
        mid = z.groupBy(*keys, "zone_id").agg(F.avg("latitude").alias("_la"), F.avg("longitude").alias("_lo"), F.count(F.lit(1)).alias("_n"))
        inertia = z.join(mid, [*keys, "zone_id"]).groupBy(*keys).agg(F.sum(haversine_km(c("latitude"), c("longitude"), c("_la"), c("_lo")) ** 2).alias("inertia"))
        balance = mid.groupBy(*keys).agg((1 - F.least(F.lit(1.0), F.coalesce(F.stddev_pop("_n") / F.avg("_n"), F.lit(0.0)))).alias("balance"))
        r = silhouette_squared(z, keys, "zone_id").join(inertia, keys).join(balance, keys).withColumn("k", F.lit(k))
        rows = r if rows is None else rows.unionByName(r)
    w = Window.partitionBy(*keys).orderBy("k")
    elbow = F.coalesce((F.lag("inertia").over(w) - c("inertia")) / F.lag("inertia").over(w), F.lit(0.0))
    s = cut(rows).withColumn("elbow", elbow).withColumn("score", 0.4 * c("silhouette") + 0.3 * c("balance") + 0.3 * c("elbow"))
    return s.withColumn("best", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "k")) == 1)


# ------------------------------------------------------------------ zones

def _radius(zoned: DataFrame, keys: list[str]) -> DataFrame:
    mid = zoned.groupBy(*keys, "zone_id").agg(F.avg("latitude").alias("_la"), F.avg("longitude").alias("_lo"), F.count(F.lit(1)).alias("n"))
    return zoned.join(mid, [*keys, "zone_id"]).groupBy(*keys, "zone_id", "n").agg(
        F.max(haversine_km(c("latitude"), c("longitude"), c("_la"), c("_lo"))).alias("radius_km"))


def split_oversized_zones(zoned: DataFrame, keys: list[str], max_radius_km: float) -> DataFrame:
    """Cut zones wider than the cap in two until all fit; only failing zones are cut. Zone ids stay unique.

    A zone of up to LINE_ROWS outlets gets all its cuts in one task; larger ones are cut in rounds until they are as small.
    The right half of a cut takes a new id: ids go on from the key's highest by the number of cuts before, then by the zone cut.
    """
    cols = [*keys, "outlet_id", "latitude", "longitude", "zone_id"]
    zone = [*keys, "zone_id", "_path"]
    start = cut(zoned.select(*cols))
    cur = start.withColumn("_path", F.lit("")).withColumn("weight", F.lit(1.0))
    while True:
        mid = cur.groupBy(*zone).agg(F.avg("latitude").alias("_la"), F.avg("longitude").alias("_lo"), F.count(F.lit(1)).alias("_n"), _few_rows("outlet_id", "weight").alias("_few"))
        large = mid.filter("(not _few or _few is null) and _n > 1")
        far = cur.join(large, zone).groupBy(*zone).agg(F.max(haversine_km(c("latitude"), c("longitude"), c("_la"), c("_lo"))).alias("_km"))
        wide = cut(far.filter(c("_km") > max_radius_km).select(*zone))
        if wide.isEmpty():
            break
        halves = line_split(cur.join(wide, zone), zone, 2, below=1.0, above=1.0).withColumn("_path", F.concat("_path", c("part").cast("string")))
        cur = cut(cur.join(wide, zone, "left_anti").unionByName(halves.select(*cur.columns)))
    rows = cur.select(*cols, _line_row("outlet_id", "weight").alias("_row"), "_path")
    few = mid.filter("_few").select(*zone)
    done = rows.join(few, zone).select(*rows.columns).groupBy(*zone).applyInArrow(_paths_of_zone(max_radius_km), rows.select(*cols, "_path").schema)
    done = cut(done.unionByName(rows.join(few, zone, "left_anti").select(*cols, "_path")))
    # The right turns of a path, last first, and the zone it began in: the order of the ids of zones that are there at one time.
    turns = lambda path: F.reverse(F.filter(F.transform(F.split(path, ""), lambda side, i: F.when(side == "1", i + 1)), lambda i: i.isNotNull()))
    cuts = done.filter("_path <> ''").select(*zone).distinct().withColumn("_at", F.explode(F.sequence(F.lit(0), F.length("_path") - 1)))
    cuts = cuts.select(*keys, "zone_id", c("_path").substr(F.lit(1), c("_at")).alias("_before")).distinct()
    order = F.concat(turns(c("_before")).cast("array<bigint>"), F.array(F.lit(0).cast("bigint"), c("zone_id").cast("bigint")))
    top = start.groupBy(*keys).agg(F.max("zone_id").alias("_top"))
    new = cuts.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.length("_before"), order))).join(top, keys).select(
        *keys, "zone_id", "_before", (c("_top") + c("_r")).cast(start.schema["zone_id"].dataType).alias("_new"))
    last = F.get(turns(c("_path")), F.lit(0))
    done = done.withColumn("_before", F.when(last.isNotNull(), c("_path").substr(F.lit(1), last - 1))).join(new, [*keys, "zone_id", "_before"], "left")
    return done.withColumn("zone_id", F.coalesce("_new", "zone_id")).select(*cols)


def merge_undersized_zones(zoned: DataFrame, keys: list[str], min_size: int, max_size: int, max_radius_km: float,
                           gap_km: float = 5.0) -> DataFrame:
    """Join small zones to the nearest zone they touch while size and width allow, until none can be joined.

    A round joins every pair that is the first choice of both zones (smaller zone first, then nearer), so
    zones all over a key merge at once. With a column ``offset`` zones that hold a flagged outlet are left out.
    """
    from beatwise.operators.spots import group_gap_km
    flags = ["offset"] if "offset" in zoned.columns else []
    cur = cut(zoned.select(*keys, "outlet_id", "latitude", "longitude", "zone_id", *flags))
    while True:
        size = cut(cur.groupBy(*keys, "zone_id").agg(F.count(F.lit(1)).alias("n"), F.avg("latitude").alias("la"), F.avg("longitude").alias("lo"),
                                                     (F.max("offset") if flags else F.lit(False)).alias("apart")))
        if size.filter((c("n") < min_size) & ~c("apart")).isEmpty():
            return cur
        wide = _radius(cur, keys).select(*keys, "zone_id", "radius_km")
        info = size.filter(~c("apart")).join(wide, [*keys, "zone_id"])
        gaps = group_gap_km(cur, keys, "zone_id", gap_km).select(*keys, "a", "b", "gap_km")
        both = gaps.union(gaps.select(*keys, c("b"), c("a"), "gap_km"))
        i = lambda e: info.select(*keys, c("zone_id").alias(e), c("n").alias(f"n_{e}"), c("la").alias(f"la_{e}"), c("lo").alias(f"lo_{e}"), c("radius_km").alias(f"r_{e}"))
        p = both.join(i("a"), [*keys, "a"]).join(i("b"), [*keys, "b"])
        reach = haversine_km(c("la_a"), c("lo_a"), c("la_b"), c("lo_b"))
        joint = (reach + c("r_a") + c("r_b")) / 2
        p = p.filter((c("n_a") < min_size) & (c("n_a") + c("n_b") <= max_size) & (F.greatest(joint, "r_a", "r_b") <= max_radius_km))
        p = p.withColumnRenamed("a", "g").withColumnRenamed("b", "h").withColumn("outlet_id", c("g"))
        go = one_to_one(p, keys, F.struct("n_a", F.round("gap_km", 9)))
        # Two small zones may have chosen each other: the lower id stays.
        pair = go.select(*keys, F.greatest("g", "h").alias("x"), F.least("g", "h").alias("y"), c("g").alias("small"), "n_a", "n_b").groupBy(*keys, "x", "y").agg(
            F.count(F.lit(1)).alias("ways"), F.min("small").alias("small"))
        go = cut(pair.select(*keys, F.when(c("ways") > 1, c("x")).otherwise(c("small")).alias("zone_id"),
                             F.when(c("ways") > 1, c("y")).when(c("small") == c("x"), c("y")).otherwise(c("x")).alias("_to")))
        if go.isEmpty():
            return cur
        cur = cut(cur.join(go, [*keys, "zone_id"], "left").withColumn("zone_id", F.coalesce("_to", "zone_id")).select(*cur.columns))


def assign_zones_to_reps(zones: DataFrame, keys: list[str], k: Column, below: float = 0.1, above: float = 0.1) -> DataFrame:
    """Zones (keys, zone_id, latitude, longitude, weight) to k reps: contiguous along the curve, loads evened over the border."""
    z = zones.withColumn("outlet_id", c("zone_id"))
    start = hilbert_partition(z, keys, k).select(*keys, "outlet_id", "weight", "group")
    graph = neighbour_graph(z, keys, 6)
    out = repair_loads(start, graph, keys, below, above, hop_km=1e9)
    return out.select(*keys, c("outlet_id").alias("zone_id"), "weight", c("group").alias("rep"))


#: Degrees of the cells of the levels on which pieces and cores come closer; each is eight of the next.
GAP_CELLS = (0.5, 0.0625, 0.0078125)


def _core_gaps(pockets: DataFrame, cores: DataFrame, keys: list[str]) -> DataFrame:
    """Gap of every pocket (keys, group, component) to its own core and to the nearest other: ``_own`` and ``_b`` (km, group).

    Cells of either side meet level by level; a pair goes on while it may hold the least gap of its pocket, so outlets are measured
    in the few cells that are left.
    """
    piece, place = [*keys, "group", "component"], ["latitude", "longitude"]
    known = c("latitude").isNotNull() & c("longitude").isNotNull()
    at = lambda df, name: df.filter(known).select(*name, *place).distinct()
    a, b = cut(at(pockets, piece)), cut(at(cores.withColumnRenamed("group", "h"), [*keys, "h"]))
    ids = lambda side, degrees: [(F.floor(c(x) / degrees) if degrees else F.lit(0)).cast("int").alias(f"_{side}{i}") for i, x in enumerate(place)]
    own = (c("group") == c("h")).alias("_mine")
    pairs, wide = None, None
    for degrees in (None, *GAP_CELLS):
        def nodes(df: DataFrame, name: list[str], side: str) -> DataFrame:
            up = [x.alias(f"_up{side}{i}") for i, x in enumerate(ids(side, wide))]
            n = df.select(*name, *up, *ids(side, degrees), *place)
            box = n.groupBy(*[x for x in n.columns if x not in place]).agg(*[f(x).alias(f"{side}_{m}{i}") for i, x in enumerate(place) for m, f in (("min", F.min), ("max", F.max))])
            lo, hi = ([c(f"{side}_{m}{i}") for i in (0, 1)] for m in ("min", "max"))
            la, lng = (lo[0] + hi[0]) / 2, (lo[1] + hi[1]) / 2
            r = F.greatest(*[haversine_km(la, lng, y, lo[1]) for y in (lo[0], hi[0])]) * 1.001 + 1e-6
            return box.select(*[x for x in box.columns if not x.startswith((f"{side}_min", f"{side}_max"))], la.alias(f"{side}_la"), lng.alias(f"{side}_lo"), r.alias(f"{side}_r"))
        na, nb = nodes(a, piece, "a"), nodes(b, [*keys, "h"], "b")
        if pairs is None:
            met = na.join(nb, keys)
        else:
            up = pairs.select(*piece, "h", *[c(f"_{x}{i}").alias(f"_up{x}{i}") for x in "ab" for i in (0, 1)])
            met = up.join(na, [*piece, "_upa0", "_upa1"]).join(nb, [*keys, "h", "_upb0", "_upb1"])
        km, r = haversine_km(c("a_la"), c("a_lo"), c("b_la"), c("b_lo")), c("a_r") + c("b_r")
        met = met.select(*piece, "h", *[f"_{x}{i}" for x in "ab" for i in (0, 1)], (km - r).alias("_least"), (km + r).alias("_most"), own)
        met = met if pairs is None else cut(met)
        best = met.groupBy(*piece, "_mine").agg(F.min("_most").alias("_best"))
        pairs, wide = cut(met.join(best, [*piece, "_mine"]).filter("_least <= _best").drop("_least", "_most", "_best", "_mine")), degrees
    side = lambda df, name, x: df.select(*name, *ids(x, wide), *[c(y).alias(f"{x}_{y}") for y in place])
    met = pairs.join(side(a, piece, "a"), [*piece, "_a0", "_a1"]).join(side(b, [*keys, "h"], "b"), [*keys, "h", "_b0", "_b1"])
    km = haversine_km(c("a_latitude"), c("a_longitude"), c("b_latitude"), c("b_longitude"))
    return met.withColumn("other_km", km).withColumn("_mine", own).groupBy(*piece).agg(
        F.min(F.when(c("_mine"), c("other_km"))).alias("_own"), F.min(F.when(~c("_mine"), F.struct("other_km", "h"))).alias("_b"))


def _payment(tagged: DataFrame, go: DataFrame, keys: list[str], hop_km: float) -> DataFrame:
    """What receivers of pockets give back: outlets of their core within the hop of the giver's core, nearest first, up to
    the load received. ``go``: keys, group, component, h. A receiver's core and its new pieces stay in as many pieces as
    they would be without; where they don't, the payment is halved until they do. Returns keys, outlet_id, h (the giver)."""
    deal = [*keys, "group", "h"]
    owed = cut(tagged.join(go, [*keys, "group", "component"]).groupBy(*deal).agg(F.sum("weight").alias("_owed")))
    pair = owed.select(*keys, c("group").alias("_giver"), c("h").alias("group"), "_owed")
    core = tagged.filter("is_core").select(*keys, "outlet_id", "group", "weight", "latitude", "longitude")
    # Only what lies in a cell of the giver's core, at least a hop wide, or beside one can be near enough.
    cell = lambda x, i: F.floor(c("latitude") * KM_PER_LAT / hop_km).cast("long") if i == 0 else F.floor(c("longitude") * KM_PER_LNG * F.cos(F.radians(c("_top"))) / hop_km).cast("long")
    top = core.groupBy(*keys).agg((F.max(F.abs("latitude")) + F.lit(hop_km / KM_PER_LAT)).alias("_top"))
    placed = core.join(top, keys).withColumns({"_y": cell("latitude", 0), "_x": cell("longitude", 1)})
    around = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    ground = placed.join(pair.select(*keys, "_giver").distinct().withColumnRenamed("_giver", "group"), [*keys, "group"], "left_semi").select(*keys, c("group").alias("_giver"), "_y", "_x").distinct().withColumn("_n", around)
    ground = ground.select(*keys, "_giver", (c("_y") + c("_n.i")).alias("_y"), (c("_x") + c("_n.j")).alias("_x")).distinct()
    asks = cut(placed.join(pair, [*keys, "group"]).join(ground, [*keys, "_giver", "_y", "_x"], "left_semi").select(*keys, "_giver", "group", "outlet_id", "weight", "latitude", "longitude", "_owed"))
    ends = core.join(asks.select(*keys, c("_giver").alias("group")).distinct(), [*keys, "group"], "left_semi").withColumnRenamed("group", "_giver")
    near = nearest(asks, ends, [*keys, "_giver"], 1, not_self=False).filter(c("km") <= hop_km).groupBy(*keys, "_giver", "outlet_id").agg(F.min("km").alias("km"))
    # An outlet that adjoins several givers pays the nearest.
    near = near.groupBy(*keys, "outlet_id").agg(F.min(F.struct("km", "_giver")).alias("_b")).select(*keys, "outlet_id", c("_b._giver").alias("_giver"), c("_b.km").alias("km"))
    offer = asks.join(near, [*keys, "_giver", "outlet_id"]).select(*keys, "_giver", "group", "outlet_id", "weight", "km", "_owed")
    offer = running_total(offer, [*keys, "_giver", "group"], F.floor(c("km") * 64), ["km", "outlet_id"], c("weight").cast("double"), "_paid")
    offer = cut(offer.filter(c("_paid") <= c("_owed")).select(*keys, "_giver", "group", "outlet_id", "_paid", "_owed"))
    if offer.isEmpty():
        return offer.select(*keys, "outlet_id", c("_giver").alias("h"))
    # The receivers' ground after the exchange: their cores and what they get.
    getting = offer.select(*keys, "group").distinct()
    gets = tagged.join(go, [*keys, "group", "component"]).select(*keys, "outlet_id", c("h").alias("group"), "latitude", "longitude")
    whole = cut(core.select(*keys, "outlet_id", "group", "latitude", "longitude").unionByName(gets).join(getting, [*keys, "group"], "left_semi"))
    pieces = lambda df: components(df, [*keys, "group"], hop_km).groupBy(*keys, "group").agg(F.count_distinct("component").alias("_n"))
    was, open_, settled = cut(pieces(whole).withColumnRenamed("_n", "_was")), offer, None
    while True:
        left = whole.join(open_.select(*keys, "group").distinct(), [*keys, "group"], "left_semi").join(open_.select(*keys, "group", "outlet_id"), [*keys, "group", "outlet_id"], "left_anti")
        bad = cut(pieces(left).join(was, [*keys, "group"]).filter("_n > _was").select(*keys, "group"))
        fine = open_.join(bad, [*keys, "group"], "left_anti")
        settled = fine if settled is None else settled.unionByName(fine)
        open_ = cut(open_.join(bad, [*keys, "group"], "left_semi").withColumn("_owed", F.least(c("_owed"), F.max("_paid").over(Window.partitionBy(*keys, "_giver", "group"))) / 2).filter(c("_paid") <= c("_owed")))
        if open_.isEmpty():
            return settled.select(*keys, "outlet_id", c("_giver").alias("h"))


def pocket_exchange(state: DataFrame, points: DataFrame, keys: list[str], hop_km: float, graph: DataFrame | None = None,
                    below: float | str = 0.1, above: float | str = 0.1) -> DataFrame:
    """Give pieces of a territory beyond the hop to the group whose core is nearer than the own core, paid with outlets that
    adjoin the giver's core; then even out (``repair_loads``). ``graph`` is the neighbour list of the points, found here if there is none."""
    pts = points.select(*keys, "outlet_id", "latitude", "longitude")
    at = cut(state.join(pts, [*keys, "outlet_id"]))
    comp = components(at, [*keys, "group"], hop_km)
    size = comp.groupBy(*keys, "group", "component").agg(F.count(F.lit(1)).alias("n"))
    core = size.groupBy(*keys, "group").agg(F.max(F.struct("n", (-c("component")).alias("p"))).alias("b")).select(*keys, "group", (-c("b.p")).alias("_core"))
    tagged = cut(at.join(comp, [*keys, "group", "outlet_id"]).join(core, [*keys, "group"]).withColumn("is_core", c("component") == c("_core")))
    pockets = tagged.filter("not is_core")
    # A pocket goes as one piece: by the closest of its outlets to either core.
    gap = _core_gaps(pockets, tagged.filter("is_core"), keys)
    go = cut(gap.filter(c("_b.other_km") < F.coalesce("_own", F.lit(1e9))).select(*keys, "group", "component", c("_b.h").alias("h")))
    moves = pockets.join(go, [*keys, "group", "component"]).select(*keys, "outlet_id", "h")
    out = _moved(state, moves.unionByName(_payment(tagged, go, keys, hop_km)), keys)
    return repair_loads(out, neighbour_graph(points, keys) if graph is None else graph, keys, below, above, hop_km)


# ------------------------------------------------------------------ days of a rep

def apportion_days(pieces: DataFrame, keys: list[str], days: Column, target: Column | None = None) -> DataFrame:
    """Days of each piece (keys, piece, load) by largest remainder, at least one each; over-allotted days are
    taken back from pieces whose days stay fullest."""
    per = Window.partitionBy(*keys)
    goal = target if target is not None else F.sum("load").over(per) / days
    p = pieces.withColumn("_days", days).withColumn("_goal", goal)
    p = p.withColumn("_q", c("load") / c("_goal")).withColumn("_d", F.greatest(F.lit(1), F.floor("_q")).cast("int"))
    p = p.withColumn("_left", c("_days") - F.sum("_d").over(per))
    p = p.withColumn("_rank", F.row_number().over(per.orderBy(F.desc(c("_q") - c("_d")), "piece")))
    p = cut(p.withColumn("_d", c("_d") + F.when(c("_left") > 0, (c("_rank") <= c("_left")).cast("int")).otherwise(0)))
    # The piece whose days would stay fullest gives first, and stays the fullest while it gives.
    spare = c("_d") - 1
    order = per.orderBy(F.desc_nulls_last(c("load") / F.when(spare > 0, spare)), "piece").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(spare).over(order), F.lit(0))
    back = F.greatest(F.lit(0), F.least(spare, -c("_left") - before))
    return p.select(*keys, "piece", "load", (c("_d") - back).cast("int").alias("days"))


def anchor_days(points: DataFrame, keys: list[str], day_groups: int, min_anchors: int | None = None) -> DataFrame:
    """Day-groups grown round the frequent outlets (vf 3 and up) when there are enough, else round all:
    anchors are cut along the curve, the others join the nearest day's centre."""
    need = min_anchors or day_groups * 2
    n = points.groupBy(*keys).agg(F.count_if(c("vf") >= 3).alias("_anchors"))
    p = cut(points.select(*keys, "outlet_id", "latitude", "longitude", "vf", c("vf").cast("double").alias("weight")).join(n, keys)
            .withColumn("_seed", (c("_anchors") < need) | (c("vf") >= 3)))
    seeds = cut(hilbert_partition(p.filter("_seed"), keys, F.lit(day_groups)).select(*keys, "outlet_id", "latitude", "longitude", c("group").alias("day_group")))
    centres = seeds.groupBy(*keys, "day_group").agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
    rest = nearest(p.filter("not _seed"), centres, keys, 1, "outlet_id", "day_group", not_self=False).select(*keys, "outlet_id", c("nbr_id").alias("day_group"))
    return seeds.select(*keys, "outlet_id", "day_group").unionByName(rest)


def overflow_memberships(points: DataFrame, homes: DataFrame, keys: list[str], repeats: int, tolerance: float = 0.06) -> DataFrame:
    """Second day-group of outlets whose frequency needs two: of the three nearest days the nearest with room,
    else the emptiest. ``homes``: keys, outlet_id, day_group. Bigger shares choose first, one per day and round.
    Where a key has one day only, ``to_day`` is null: the share has no second day to go to."""
    p = points.select(*keys, "outlet_id", "latitude", "longitude", "vf").join(homes, [*keys, "outlet_id"])
    load = p.groupBy(*keys, "day_group").agg(F.sum(F.least(c("vf"), F.lit(repeats)) / repeats).alias("load"),
                                             F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
    over = p.filter(c("vf") > repeats).withColumn("share", c("vf") - repeats)
    near = nearest(over.select(*keys, "outlet_id", "latitude", "longitude"), load, keys, 4, "outlet_id", "day_group", not_self=False)
    cand = near.select(*keys, "outlet_id", c("nbr_id").alias("to_day"), "km").join(over.select(*keys, "outlet_id", c("day_group").alias("home"), "share"), [*keys, "outlet_id"]).filter("to_day <> home")
    cand = cut(cand.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "outlet_id").orderBy("km", "to_day"))).filter("_n <= 3"))
    total = p.groupBy(*keys).agg((F.sum(F.lit(0.0) + c("vf")) / repeats / F.count_distinct("day_group")).alias("mean"))
    placed = None
    loads = load.select(*keys, "day_group", "load")
    # Every round places at least one outlet of each day that has open ones, so it ends.
    while True:
        open_ = cand if placed is None else cand.join(placed.select(*keys, "outlet_id"), [*keys, "outlet_id"], "left_anti")
        if open_.isEmpty():
            break
        now = loads if placed is None else loads.join(placed.groupBy(*keys, c("to_day").alias("day_group")).agg((F.sum("share") / repeats).alias("_add")), [*keys, "day_group"], "left").select(*keys, "day_group", (c("load") + F.coalesce("_add", F.lit(0.0))).alias("load"))
        d = open_.join(now.withColumnRenamed("day_group", "to_day"), [*keys, "to_day"]).join(total, keys)
        room = c("load") + c("share") / repeats <= c("mean") * (1 + tolerance)
        pick = d.groupBy(*keys, "outlet_id", "share").agg(F.coalesce(
            F.min(F.when(room, F.struct(F.lit(0.0).alias("a"), c("_n").cast("double").alias("b"), c("to_day")))), F.min(F.struct(F.lit(1.0).alias("a"), c("load").alias("b"), c("to_day")))).alias("b"))
        first = Window.partitionBy(*keys, "to_day").orderBy(F.desc("share"), "outlet_id")
        step = pick.select(*keys, "outlet_id", "share", c("b.to_day").alias("to_day")).withColumn("_r", F.row_number().over(first))
        # Up to a tenth of the open ones of a day at once keeps the rounds few on large reps.
        many = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(Window.partitionBy(*keys, "to_day")) / 10))
        step = step.withColumn("_m", many).filter(c("_r") <= c("_m")).drop("_r", "_m")
        placed = cut(step if placed is None else placed.unionByName(step))
    lone = over.select(*keys, "outlet_id", "share").join(cand.select(*keys, "outlet_id"), [*keys, "outlet_id"], "left_anti")
    lone = lone.withColumn("to_day", F.lit(None).cast(cand.schema["to_day"].dataType))
    return lone if placed is None else placed.select(*keys, "outlet_id", "share", "to_day").unionByName(lone)


def territory_feedback(state: DataFrame, graph: DataFrame, need: DataFrame, keys: list[str], hop_km: float) -> DataFrame:
    """Move border outlets toward territories whose days came out short, within twice the hop, until no more can go.

    ``need`` has keys, group and the load wanted (positive: short, negative: over). With columns ``give`` and
    ``take`` groups that are neither may give, or take, that much; an outlet moves only if one of the two sides
    is in need, and never more than is needed there and allowed on the other side.
    """
    more = lambda name, sign: c(name) if name in need.columns else F.greatest(F.lit(0.0), sign * c("need"))
    left = cut(need.select(*keys, "group", c("need").cast("double").alias("need"), more("give", -1).cast("double").alias("give"), more("take", 1).cast("double").alias("take")))
    cur = cut(state)
    told = cut(cur.join(left, [*keys, "group"], "left"))
    small, others = mv.by_size(told, keys)
    moved = mv.settled(told.join(small, keys, "left_semi") if others else told, graph, keys, None, mv.feedback(hop_km), False, cur.columns)
    if not others:
        return moved
    cur = cut(cur.join(small, keys, "left_anti"))
    while True:
        t = _touching(cur, graph, keys).filter("g <> h").filter(c("km") <= 2 * hop_km)
        side = lambda e: left.select(*keys, c("group").alias(e), *[c(x).alias(f"{e}_{x}") for x in ("need", "give", "take")])
        pull = F.when(c("h_need") > 0, F.least(c("h_need"), c("g_give"))).otherwise(0.0)
        push = F.when(c("g_need") < 0, F.least(-c("g_need"), c("h_take"))).otherwise(0.0)
        d = t.join(side("g"), [*keys, "g"]).join(side("h"), [*keys, "h"]).withColumn("_most", F.greatest(pull, push)).filter(c("weight") <= c("_most"))
        d = one_to_one(d, keys, c("km"))
        w = Window.partitionBy(*keys, "g", "h").orderBy("km", "outlet_id").rowsBetween(Window.unboundedPreceding, 0)
        moves = cut(d.withColumn("_s", F.sum("weight").over(w)).filter(c("_s") <= c("_most")))
        if moves.isEmpty():
            return moved.unionByName(cur)
        cur = _moved(cur, moves, keys)
        delta = moves.select(*keys, c("g").alias("group"), c("weight").alias("_d")).union(moves.select(*keys, c("h"), -c("weight")))
        delta = delta.groupBy(*keys, "group").agg(F.sum("_d").alias("_d"))
        d = F.coalesce("_d", F.lit(0.0))
        # What has been given or taken is used up on both sides.
        met = F.when(c("need") > 0, F.greatest(F.lit(0.0), c("need") + F.least(F.lit(0.0), d))).otherwise(F.least(F.lit(0.0), c("need") + F.greatest(F.lit(0.0), d)))
        left = cut(left.join(delta, [*keys, "group"], "left").select(*keys, "group", met.alias("need"), (c("give") - F.abs(d)).alias("give"), (c("take") - F.abs(d)).alias("take")))


def zones_to_days(zoned: DataFrame, keys: list[str], days: int, day_cap: float) -> DataFrame:
    """Exactly ``days`` zones per key (fewer only where there are fewer outlets): zones are merged by reciprocal
    nearest neighbours while two fit the cap together, else the lightest are, or the heaviest are cut in two.

    A round merges all pairs of a key that are each other's nearest fitting zone, nearest pairs first and no
    more than it has too many. Keys that have their zones leave the loop. Columns: outlet_id, zone_id, weight.
    """
    cur, done = cut(zoned.select(*keys, "outlet_id", "latitude", "longitude", "weight", "zone_id")), None
    by_load = Window.partitionBy(*keys).orderBy("load", "zone_id")
    while True:
        z = cut(cur.groupBy(*keys, "zone_id").agg(F.sum("weight").alias("load"), F.count(F.lit(1)).alias("n"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude")))
        count = z.groupBy(*keys).agg(F.count(F.lit(1)).alias("zones"), F.max(F.when(c("n") > 1, c("load"))).alias("heaviest"))
        off = cut(count.filter((c("zones") > days) | ((c("zones") < days) & c("heaviest").isNotNull())))
        rest = cur.join(off, keys, "left_anti")
        done = rest if done is None else done.unionByName(rest)
        if off.isEmpty():
            return done
        a = z.join(off.filter(c("zones") > days).select(*keys, (c("zones") - days).alias("extra")), keys)
        # The nearest zone that fits: among the nearest few, else, for the lightest zone of a key, among all.
        near = nearest(a, a, keys, 4, "zone_id", "zone_id", carry=("load",)).join(a.select(*keys, "zone_id", "load"), [*keys, "zone_id"])
        near = near.filter(c("load") + c("nbr_load") <= day_cap)
        first = cut(near.groupBy(*keys, "zone_id").agg(F.min(F.struct(F.round("km", 9).alias("km"), c("nbr_id"))).alias("f")).select(*keys, "zone_id", "f.km", "f.nbr_id"))
        back = first.select(*keys, c("zone_id").alias("nbr_id"), c("nbr_id").alias("zone_id"))
        pairs = first.join(back, [*keys, "zone_id", "nbr_id"]).filter("zone_id < nbr_id").select(*keys, c("zone_id").alias("_to"), c("nbr_id").alias("_from"), "km")
        light = a.withColumn("_r", F.row_number().over(by_load))
        two = light.filter("_r <= 2").groupBy(*keys).agg(F.sum("load").alias("least"), F.min(F.struct("_r", "zone_id")).alias("one"), F.max(F.struct("_r", "zone_id")).alias("two"))
        stuck = two.join(pairs.select(*keys).distinct(), keys, "left_anti")
        lone = stuck.filter(c("least") <= day_cap).select(*keys, c("one.zone_id").alias("_own"))
        mine = a.join(lone, keys).filter("zone_id = _own").select(*keys, "_own", c("load").alias("_l"), c("latitude").alias("_la"), c("longitude").alias("_lo"))
        far = a.join(mine, keys).filter((c("zone_id") != c("_own")) & (c("load") + c("_l") <= day_cap)).groupBy(*keys, "_own").agg(
            F.min(F.struct(haversine_km(c("latitude"), c("longitude"), c("_la"), c("_lo")).alias("km"), c("zone_id"))).alias("f"))
        pairs = pairs.unionByName(far.select(*keys, F.least("_own", "f.zone_id").alias("_to"), F.greatest("_own", "f.zone_id").alias("_from"), c("f.km").alias("km")))
        # Nothing fits: neighbours in the order of loads, as long as they are lighter than the first two together.
        heavy = light.join(stuck.filter(c("least") > day_cap).select(*keys, "least"), keys)
        rank = Window.partitionBy(*keys, F.floor((c("_r") - 1) / 2)).orderBy("_r")
        heavy = heavy.withColumn("_with", F.lead("zone_id").over(rank)).withColumn("_with_load", F.lead("load").over(rank)).filter(
            (c("_r") % 2 == 1) & c("_with").isNotNull() & ((c("_r") == 1) | (c("_with_load") <= c("least"))))
        pairs = pairs.unionByName(heavy.select(*keys, F.least("zone_id", "_with").alias("_to"), F.greatest("zone_id", "_with").alias("_from"), c("_r").cast("double").alias("km")))
        order = Window.partitionBy(*keys).orderBy("km", "_to")
        merge = pairs.join(a.select(*keys, "extra").distinct(), keys).withColumn("_r", F.row_number().over(order)).filter(c("_r") <= c("extra")).select(
            *keys, c("_from").alias("zone_id"), c("_to").alias("_new"))
        # Too few: the heaviest zones, down to half the heaviest's load, are cut in two.
        short = z.filter("n > 1").join(off.filter(c("zones") < days).select(*keys, "heaviest", (days - c("zones")).alias("lack")), keys)
        turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("load"), "zone_id"))
        few = cut(short.withColumn("_r", turn).filter((c("_r") <= c("lack")) & ((c("_r") == 1) | (c("load") > c("heaviest") / 2))).select(*keys, "zone_id", "_r"))
        nxt = cur.join(off.select(*keys), keys, "left_semi").join(merge, [*keys, "zone_id"], "left").withColumn("zone_id", F.coalesce("_new", "zone_id")).drop("_new")
        if not few.isEmpty():
            half = line_split(cur.join(few.select(*keys, "zone_id"), [*keys, "zone_id"]), [*keys, "zone_id"], 2, below=0.3, above=0.3).filter("part = 1")
            top = z.groupBy(*keys).agg(F.max("zone_id").alias("_top"))
            moved = half.select(*keys, "outlet_id", "zone_id").join(few, [*keys, "zone_id"]).join(top, keys).select(*keys, "outlet_id", (c("_top") + c("_r")).alias("_new"))
            nxt = nxt.join(moved, [*keys, "outlet_id"], "left").withColumn("zone_id", F.coalesce("_new", "zone_id")).drop("_new")
        cur = cut(nxt.select(*cur.columns))
