"""Nearest rows: best matches by block of feature vectors, candidate cells of projected features, and exact nearest neighbours in the plane."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .rounds import joined, shared_folder, unused, written

#: Rows of a block, and rows of one side that are compared with a block at a time.
BLOCK, STRIP = 1024, 32
#: Signs of the sums that place a vector in a cell: all plus, or changing after so many components. Rows of one side in the fullest cell of the first round.
SIGNS, CELL = (0, 1, 2), 64


def _large(rows: DataFrame, keys: list[str], size: int, n: str) -> DataFrame:
    """(keys, n): keys of over `size` rows."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > size)


def _block_pairs(left: DataFrame, right: DataFrame, keys: list[str], size: int, path: str | None = None) -> DataFrame:
    """(keys, ids, vecs, jds, wecs): every block of left rows (id, vec) with every block of right ones of equal keys. Rows are in blocks of about `size`, dealt by a hash of the id.

    Blocks of the left are dealt to as many shares as the root of their number, each of which meets all of the right, so one key is many tasks' work.
    With a path keys of many rows are written there, so that it is known how few they are: for keys that are nearly as many as rows.
    """
    n, block, share = unused([*left.columns, *right.columns], "n", "block", "share")
    large = [_large(rows, keys, size, n) for rows in (left, right)]
    if path:
        large = [written(x, f"{path}/large{k}") for k, x in enumerate(large)]
    many = F.coalesce(F.ceil(F.col(n) / size), F.lit(1)).cast("long")
    shares = F.ceil(F.sqrt(many)).cast("long")
    dealt = lambda rows, k: joined(rows, large[k], keys, "left").withColumn(block, F.pmod(F.xxhash64("id"), many))
    l = dealt(left, 0).withColumn(share, F.pmod(F.col(block), shares)).drop(n)
    r = joined(dealt(right, 1).drop(n), large[0], keys, "left").withColumn(share, F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).drop(n)

    def blocks(rows: DataFrame, ids: str, vecs: str) -> DataFrame:
        both = rows.groupBy(*keys, share, block).agg(F.collect_list(F.struct("id", F.col("vec").cast("array<double>").alias("vec"))).alias("x"))
        return both.select(*keys, share, F.col("x.id").alias(ids), F.flatten("x.vec").alias(vecs))

    return joined(blocks(l, "ids", "vecs"), blocks(r, "jds", "wecs"), [*keys, share], wide=True).drop(share)


def _first(cost: np.ndarray, other: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's n least costs; of equal costs the lesser ids of the other side come first."""
    n = min(n, cost.shape[1])
    own, at = np.nonzero(~(cost > np.partition(cost, n - 1, axis=1)[:, n - 1 : n]))
    order = np.lexsort((other[at], cost[own, at], own))
    own, at = own[order], at[order]
    kept = np.arange(len(own)) - np.searchsorted(own, own) < n
    return own[kept], at[kept]


def _least(keys: list[str], n: int, digits: int | None, sides: tuple[int, ...] = (0, 1), ratio: float | None = None):
    """Pairs of blocks to (keys, of, i, j, cost): the n least costs of each row of these sides, in terms of this pair of blocks.

    With a ratio only costs up to `sure` of the pair of blocks, with `ok`: whether `ratio` times as much is up to it too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                i, j = (b.column(c)[r].values.to_numpy() for c in ("ids", "jds"))
                x, y = (b.column(c)[r].values.to_numpy().reshape(len(k), -1) for c, k in (("vecs", i), ("wecs", j)))
                cost = np.concatenate([np.abs(x[s : s + STRIP, None] - y[None]).sum(2) for s in range(0, len(i), STRIP)])
                if digits is not None:
                    cost = np.round(cost, digits)
                found = []
                for side in sides:
                    own, at = _first(cost if side == 0 else cost.T, j if side == 0 else i, n)
                    pair = (own, at) if side == 0 else (at, own)
                    found.append((np.full(len(own), side), i[pair[0]], j[pair[1]], cost[pair]))
                side, a, c, d = (np.concatenate(v) for v in zip(*found, strict=True))
                if ratio is not None:
                    sure = b.column("sure")[r].as_py()
                    near = d <= sure
                    side, a, c, d = side[near], a[near], c[near], d[near]
                at = pa.array(np.full(len(a), r))
                told = [pa.array(side, pa.int32()), pa.array(a), pa.array(c), pa.array(d)] + ([] if ratio is None else [pa.array(ratio * d <= sure)])
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in keys), *told], names=[*keys, *"of i j cost ok".split()[: len(told)]])

    return run


def _kinds(rows: DataFrame, by: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ", ".join(f"`{k}` {kinds[k]}" for k in by) + ", of int, i long, j long, cost double"


def _of_row(by: list[str]) -> WindowSpec:
    return Window.partitionBy(*by, "of", F.when(F.col("of") == 0, F.col("i")).otherwise(F.col("j")))


def _ranked(found: DataFrame, by: list[str], n: int) -> DataFrame:
    other = F.when(F.col("of") == 0, F.col("j")).otherwise(F.col("i"))
    return found.withColumn("rank", F.row_number().over(_of_row(by).orderBy("cost", other))).where(F.col("rank") <= n)


def least_costs(left: DataFrame, right: DataFrame, by: list[str], n: int, digits: int | None = None, block: int = BLOCK, cells: list[str] | None = None, sides: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(by, of, i, j, cost, rank): of each row (id, vec) of left (`of` 0) and of right (1) the n of the other side with the least sum of absolute differences.

    Every block of one side meets every block of the other of equal `by` (and cells, if rows have such columns), and gives only its rows' n best, so a pair of images makes n
    rows for each corner and block and no row for each pair. Costs are rounded to `digits` first, if given; ties go to the other side's
    lesser id. Vectors of a group are of one length and without nulls. sides: whose rows are told of.
    """
    # Nulls are a value of their own.
    pairs = _block_pairs(left, right, [*by, *(cells or [])], block).select(*by, "ids", "vecs", "jds", "wecs")
    found = pairs.mapInArrow(_least(by, n, digits, sides), _kinds(left, by))
    if cells:
        found = found.distinct()  # a pair may meet in several cells
    return _ranked(found, by, n)


def close_costs(left: DataFrame, right: DataFrame, by: list[str], n: int, ratio: float, digits: int | None = None, cell: int = CELL, rounds: int = 2) -> DataFrame:
    """What `least_costs` tells, but beyond each row's first only while the cost is at most ratio times the first; exact, and not all rows meet where the least costs are small.

    A sum of a vector's components, each taken with a sign of its own, changes by no more than the sum of absolute differences. Three such sums place a row in a cell;
    rows of one side also go to the other cells within reach, a quarter of a cell, so all pairs up to that cost meet, once. A row is done when ratio times its least cost is
    within reach. The others look again with cells four times as wide, and after these rounds meet all rows. The first cells would hold `cell` rows where they are fullest, if sums were normally distributed.
    """
    path = shared_folder(left.sparkSession, "close")
    sums, size, width, sure, *cs = unused([*by, "id", "vec", "ids", "vecs", "jds", "wecs", "of", "i", "j", "cost", "ok"], "sums", "size", "width", "sure", *(f"c{p}" for p in range(len(SIGNS))))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    signed = lambda every: total(F.transform("vec", lambda x, k: F.when(F.floor(k / every) % 2 == 0, x).otherwise(-x)) if every else F.col("vec"))

    def side(rows: DataFrame, k: int) -> DataFrame:
        rows = rows.select(*by, "id", F.col("vec").cast("array<double>").alias("vec"))
        return written(rows.select("*", F.array(*[signed(every) for every in SIGNS]).alias(sums), total(F.transform("vec", F.abs)).alias(size)), f"{path}/side{k}")

    left, right = side(left, 0), side(right, 1)
    both = left.select(*by, sums, size, F.lit(0).alias(width)).unionAll(right.select(*by, sums, size, F.lit(1).alias(width)))
    spread = F.sqrt(sum(F.var_pop(F.col(sums)[p]) for p in range(len(SIGNS))) / len(SIGNS)) * (2 * np.pi) ** 0.5
    cube = F.pow(cell / F.greatest(F.sum(width), F.lit(1)), F.lit(1 / len(SIGNS)))
    # What rounding may add to sums and costs is taken off.
    slack = F.max(size) * 1e-12 + (10.0**-digits if digits is not None else 0.0)
    groups = written(both.groupBy(*by).agg((spread * cube).alias(width), slack.alias(size)).where((F.col(width) > 0) & (F.col(width) < float("inf"))), f"{path}/groups")
    done, asks = None, {0: left, 1: right}
    for k in range(rounds):
        wide = F.col(width) * float(4**k)

        def placed(rows: DataFrame, reach: float) -> DataFrame:
            rows = joined(rows, groups.select(*by, width), by)
            for p, c in enumerate(cs):
                at = lambda d: F.floor(F.col(sums)[p] / wide + d)
                rows = rows.withColumn(c, F.explode(F.sequence(at(-reach), at(reach))) if reach else at(0))
            return rows.select(*by, *cs, "id", "vec")

        # The first round tells both sides' rows what they meet; later ones ask for the rows of one side.
        parts = [((0, 1), left, right)] if k == 0 else [((0,), asks[0], right), ((1,), left, asks[1])]
        reached = groups.select(*by, (wide * 0.999 / 4 - F.col(size)).alias("sure"))
        for sides, l, r in parts:
            name = f"{path}/round{k}{sides[0]}"
            pairs = _block_pairs(placed(l, 0 if sides == (1,) else 0.25), placed(r, 0.25 if sides == (1,) else 0), [*by, *cs], BLOCK, name)
            found = joined(pairs, reached, by).select(*by, "ids", "vecs", "jds", "wecs", "sure").mapInArrow(_least(by, n, digits, sides, ratio), f"{_kinds(left, by)}, ok boolean")
            found = written(_ranked(found, by, n).withColumn("ok", F.max("ok").over(_of_row(by))).where("ok").drop("ok"), f"{name}/found")
            done = found if done is None else done.unionAll(found)
            for s in sides:
                own = found.where((F.col("of") == s) & (F.col("rank") == 1)).select(*by, F.col("ij"[s]).alias("id"))
                asks[s] = written(joined(asks[s], own, [*by, "id"], "left_anti", wide=True), f"{path}/asks{k}{s}")
        if all(x.isEmpty() for x in asks.values()):
            break
    for s, l, r in ((0, asks[0], right), (1, left, asks[1])):
        if not asks[s].isEmpty():
            done = done.unionAll(least_costs(l.select(*by, "id", "vec"), r.select(*by, "id", "vec"), by, n, digits, sides=(s,)))
    best = F.min("cost").over(_of_row(by))
    return done.withColumn("best", best).where((F.col("rank") == 1) | (F.col("cost") <= ratio * F.col("best"))).drop("best")


def projected_cells(rows: DataFrame, dim: int, width: float, tables: int = 8, projections: int = 4, seed: int = 0) -> DataFrame:
    """rows (vec) once for each table, with `cell`: where `projections` Cauchy projections of the vector, shifted at random, fall in steps of `width`.

    Such a projection changes with the sum of absolute differences, so near vectors often share a cell of one of the tables.
    """
    rng = np.random.default_rng(seed)
    v = F.col("vec").cast("array<double>")

    def step(t: int) -> Column:
        a, b = rng.standard_cauchy((projections, dim)), rng.uniform(0, width, projections)
        at = [F.floor((F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in a[p]]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) + float(b[p])) / width) for p in range(projections)]
        return F.xxhash64(F.lit(t), *at)

    return rows.withColumn("cell", F.explode(F.array(*[step(t) for t in range(tables)])))


def nearest_in_plane(points: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by, id, other, d2, rank): the k nearest other points (id, x, y) of each point of its group, exactly; of equal distances the lesser id is nearer.

    A point first looks into the cells around its own, whose size would hold k points or so if all lay evenly. It is done when its k-th nearest lies no farther than what these cells
    are sure to cover; the others look again with cells twice as wide, until a cell spans the group. Points without a position are dropped.
    """
    path = shared_folder(points.sparkSession, "nearest")
    p = points.select(*by, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    span = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    area = F.greatest((F.max("x") - F.min("x")) * (F.max("y") - F.min("y")), span * span * 1e-6)
    boxes = p.groupBy(*by).agg(span.alias("span"), F.sqrt(area * (k + 1) / (3 * F.count(F.lit(1)))).alias("side"), F.min("x").alias("ox"), F.min("y").alias("oy"))
    p = written(joined(p, boxes, by).withColumn("side", F.when(F.col("side") > 0, F.col("side")).otherwise(1.0)), f"{path}/points")
    asks, done, i = p, None, 0
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    while not asks.isEmpty():
        side = F.col("side") * float(2**i)
        cell = lambda c, o: F.floor((F.col(c) - F.col(o)) / side).cast("long")
        there = p.select(*by, cell("x", "ox").alias("cx"), cell("y", "oy").alias("cy"), F.col("id").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        here = asks.withColumn("c", F.explode(offsets)).withColumn("cx", cell("x", "ox") + F.col("c.a")).withColumn("cy", cell("y", "oy") + F.col("c.b")).drop("c")
        met = joined(here, there, [*by, "cx", "cy"], wide=True).where("id <> other")
        d2 = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2"))
        sure = (side * side).alias("sure")
        ranked = met.select(*by, "id", "other", d2.alias("d2"), sure).withColumn("rank", F.row_number().over(Window.partitionBy(*by, "id").orderBy("d2", "other"))).where(F.col("rank") <= k)
        ranked = written(ranked, f"{path}/ranked{i}")
        ready = ranked.groupBy(*by, "id").agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("far"), F.first("sure").alias("sure")).where(F.col("n") == k).where("far < sure").select(*by, "id")
        all_seen = asks.where(side > F.col("span")).select(*by, "id")
        ready = written(ready.unionAll(all_seen).distinct(), f"{path}/ready{i}")
        own = joined(ranked, ready, [*by, "id"], "left_semi", wide=True).select(*by, "id", "other", "d2", "rank")
        done = own if done is None else done.unionAll(own)
        asks = written(joined(asks, ready, [*by, "id"], "left_anti", wide=True), f"{path}/asks{i}")
        i += 1
    return done if done is not None else p.select(*by, "id", F.col("id").alias("other"), F.lit(0.0).alias("d2"), F.lit(0).alias("rank")).limit(0)
