"""Convex hulls of groups and the overlap of group areas."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwise.functions.geo import point_in_ring

RING = "array<struct<x:double,y:double>>"


def _chain(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Monotone chain over distinct points; fewer than three points come back as they are."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and ((out[-1][0] - out[-2][0]) * (p[1] - out[-2][1])
                                    - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def hull_of(x: str, y: str) -> Column:
    """Grouped aggregate: the hull ring of a group's points."""
    def ring(xs: pd.Series, ys: pd.Series) -> list:
        return [{"x": a, "y": b} for a, b in _chain(list(zip(xs, ys)))]
    return F.pandas_udf(ring, RING)(F.col(x), F.col(y))


def _partial(keys: list[str]):
    """Hull points of each group within one Arrow batch: the map-side combine of a hull. Groups with a
    handful of points in the batch pass as they are."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            many = batch.groupby(keys, sort=False)["x"].transform("size") > 32
            yield batch[~many]
            for _, g in batch[many].groupby(keys, sort=False):
                ring = set(_chain(list(zip(g["x"], g["y"]))))
                yield g[[p in ring for p in zip(g["x"], g["y"])]]
    return run


def convex_hulls(points: DataFrame, group: list[str]) -> DataFrame:
    """Hull of each group's (longitude, latitude) points as ``ring``, with its box.

    Batches are reduced to their own hull points before the shuffle, so only border points of a
    group travel and meet, however many outlets it has.
    """
    xy = points.select(*group, F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    few = xy.mapInPandas(_partial(group), xy.schema)
    return few.groupBy(*group).agg(
        hull_of("x", "y").alias("ring")).select(
        *group, "ring", F.array_min(F.transform("ring", lambda p: p["x"])).alias("min_x"),
        F.array_max(F.transform("ring", lambda p: p["x"])).alias("max_x"),
        F.array_min(F.transform("ring", lambda p: p["y"])).alias("min_y"),
        F.array_max(F.transform("ring", lambda p: p["y"])).alias("max_y"))


def overlap_share(members: DataFrame, scope: list[str], group: str, grid: float | None = None) -> DataFrame:
    """Share of each scope's members that lie inside another group's area: scope, inside, members, share.

    ``members`` has scope, group, outlet_id, latitude, longitude, one row per member of a group. An
    area is the hull of the group's own members: those it shares with the member's group do not
    count. With ``grid`` (degrees) boxes meet members through grid cells, for scopes of many groups.
    """
    c = F.col
    m = members.select(*scope, c(group).alias("_a"), "outlet_id", c("longitude").alias("x"), c("latitude").alias("y"))
    hulls = convex_hulls(members, [*scope, group]).withColumnRenamed(group, "_b")
    boxed = (c("x").between(c("min_x"), c("max_x"))) & (c("y").between(c("min_y"), c("max_y")))
    if grid:
        span = lambda lo, hi: F.sequence(F.floor(c(lo) / grid).cast("bigint"), F.floor(c(hi) / grid).cast("bigint"))
        tiles = (hulls.withColumn("_cx", F.explode(span("min_x", "max_x"))).withColumn("_cy", F.explode(span("min_y", "max_y"))))
        at = m.withColumn("_cx", F.floor(c("x") / grid).cast("bigint")).withColumn("_cy", F.floor(c("y") / grid).cast("bigint"))
        near = at.join(tiles, [*scope, "_cx", "_cy"])
    else:
        near = m.join(hulls, scope)
    near = near.filter((c("_a") != c("_b")) & boxed)
    member_of = m.select(*scope, c("_a").alias("_b"), "outlet_id").distinct()
    near = near.join(member_of, [*scope, "_b", "outlet_id"], "left_anti")
    # Pairs of groups with a common member: there the other group's area leaves the common ones out.
    both = m.select(*scope, "_a", "outlet_id").join(m.select(*scope, c("_a").alias("_b"), "outlet_id"), [*scope, "outlet_id"])
    shared = both.filter("_a <> _b").select(*scope, "_a", "_b").distinct()
    own = (shared.join(m.select(*scope, c("_a").alias("_b"), "outlet_id", c("x").alias("longitude"), c("y").alias("latitude")), [*scope, "_b"])
           .join(m.select(*scope, "_a", "outlet_id"), [*scope, "_a", "outlet_id"], "left_anti"))
    own_hulls = convex_hulls(own, [*scope, "_a", "_b"]).select(*scope, "_a", "_b", c("ring").alias("_own"))
    tested = (near.join(shared.withColumn("_shared", F.lit(True)), [*scope, "_a", "_b"], "left")
              .join(own_hulls, [*scope, "_a", "_b"], "left"))
    area = F.when(c("_shared"), F.coalesce("_own", F.array().cast(RING))).otherwise(c("ring"))
    inside = tested.filter(point_in_ring(area, c("x"), c("y"))).select(*scope, "_a", "outlet_id").distinct()
    n_in = inside.groupBy(*scope).agg(F.count(F.lit(1)).alias("inside"))
    return (m.groupBy(*scope).agg(F.count(F.lit(1)).alias("members")).join(n_in, scope, "left")
            .withColumn("inside", F.coalesce("inside", F.lit(0)))
            .withColumn("share", c("inside") / c("members")))
