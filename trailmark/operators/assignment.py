"""Least-cost assignment by auction: rows bid for columns, block by block, and the highest bids of all blocks stand.

Costs become whole numbers. A pair is worth what it saves against leaving its row without a match. Rows and columns may stay alone: each has a
stand-in on the other side that is worth nothing, and a pair's two stand-ins may take each other. So everything can be placed, prices may be
carried from one step of epsilon to the next smaller one, and with the last one, under 1 / places, the result is a least-cost one.
"""

from __future__ import annotations

from collections import deque
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rounds import joined, shared_folder, written

#: Bidders of one task, and by how much epsilon falls.
BLOCK, FACTOR = 1 << 17, 8


def _bids(edges: dict[int, list[tuple[int, int]]], price: dict[int, int], holder: dict[int, int], waiting: list[int], epsilon: int) -> set[int]:
    """Let the waiting ones bid until none waits; updates prices and holders, gives the places whose holder changed.

    A bidder takes the place of most value and raises its price by what it is worth more than the second one, and epsilon. Who held it waits
    again if it's of this block.
    """
    taken, queue = set(), deque(waiting)
    while queue:
        b = queue.popleft()
        first = second = None
        for place, worth in edges[b]:
            v = worth - price.get(place, 0)
            if first is None or v > first:
                first, second, best = v, first, place
            elif second is None or v > second:
                second = v
        price[best] = price.get(best, 0) + (first - second if second is not None else 0) + epsilon
        out = holder.get(best)
        holder[best] = b
        taken.add(best)
        if out in edges:
            queue.append(out)
    return taken


def _steps(most: int, places: int) -> list[int]:
    """Epsilons in units of 1 / (places + 1), from a quarter of the largest worth down to 1 unit."""
    out, e = [1], 1
    while e * FACTOR < most * (places + 1) // 4:
        e *= FACTOR
        out.append(e)
    return out[::-1]


def _edges(frame: pd.DataFrame, scale: int) -> dict[int, list[tuple[int, int]]]:
    edges: dict[int, list[tuple[int, int]]] = {}
    for b, p, w in zip(frame["bidder"].tolist(), frame["place"].tolist(), frame["worth"].tolist(), strict=True):
        edges.setdefault(b, []).append((p, w * scale))
    return edges


def _whole(frame: pd.DataFrame) -> dict[int, int]:
    """Place of each bidder of a group that one task holds: all steps of epsilon at once."""
    places = frame["place"].nunique()
    edges, price, holder = _edges(frame, places + 1), {}, {}
    for e in _steps(int(frame["worth"].max()), places):
        holder = {}
        _bids(edges, price, holder, sorted(edges), e)
    return holder


def assignment(cost: DataFrame, by: list[str], skip: str | float, best: int | None = None, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """(by, i, j, cost): the pairs of a matching of each group whose costs, with `skip` for each row without a match, are least.

    cost: (by, i, j, cost) of the pairs that may match, ids not negative; skip: a number, or a column of cost that holds one for each group. Pairs at `skip` or more never match; `best` keeps the
    that many least costs of each row only, ties by j. Costs count to `digits` decimal places. A group of up to `block` bidders is one task's auction;
    of a larger one each block of bidders bids by itself, knowing prices and holders, then for every place the highest price stands and those outbid wait for the next
    round. Rounds are written, so none is done twice when executors are lost.
    """
    path = shared_folder(cost.sparkSession, "assignment")
    scale = 10**digits
    at = F.col(skip) if isinstance(skip, str) else F.lit(float(skip))
    worth = (F.round(at * scale) - F.round(F.col("cost") * scale)).cast("long")
    c = cost.select(*by, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "cost", worth.alias("worth")).where("worth > 0")
    if best is not None:
        c = c.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "i").orderBy("cost", "j"))).where(F.col("rank") <= best).drop("rank")
    c = written(c, f"{path}/pairs")
    # Even numbers are rows, odd ones columns; a place is named after what it stands for.
    row, col = F.col("i") * 2, F.col("j") * 2 + 1
    pair = c.select(*by, F.explode(F.array(F.struct(row.alias("bidder"), col.alias("place"), F.col("worth")), F.struct(col.alias("bidder"), row.alias("place"), F.lit(0).cast("long").alias("worth")))).alias("e"))
    alone = c.select(*by, F.explode(F.array(row, col)).alias("bidder")).distinct()
    edges = pair.select(*by, "e.*").unionAll(alone.select(*by, "bidder", F.col("bidder").alias("place"), F.lit(0).cast("long").alias("worth")))
    sizes = edges.groupBy(*by).agg(F.countDistinct("bidder").alias("places"), F.max("worth").alias("most"))
    sizes = written(sizes, f"{path}/sizes")
    edges = written(joined(edges, sizes, by), f"{path}/edges")
    kinds = ", ".join(f"`{b}` {c.schema[b].dataType.simpleString()}" for b in by)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        held = _whole(frame)
        out = pd.DataFrame({"place": list(held), "bidder": list(held.values())}, dtype="int64")
        for b in by:
            out[b] = frame[b].iloc[0]
        return out[[*by, "place", "bidder"]]

    small = edges.where(F.col("places") <= block)
    # Groups are small in bytes and long in time, so as many tasks as there may be take them.
    small = small.repartition(int(cost.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by) if by else small
    held = small.groupBy(*by).applyInPandas(one, f"{kinds}, place long, bidder long")
    large = written(edges.where(F.col("places") > block).withColumn("block", F.pmod(F.xxhash64("bidder"), F.ceil(F.col("places") / block))), f"{path}/large")
    if not large.isEmpty():
        held = held.unionAll(_in_rounds(large, by, kinds, path))
    found = held.where("bidder % 2 = 0 and place % 2 = 1").select(*by, F.floor(F.col("bidder") / 2).alias("i"), F.floor(F.col("place") / 2).alias("j"))
    return joined(c, found, [*by, "i", "j"], "left_semi", wide=True).select(*by, "i", "j", "cost")


def _in_rounds(edges: DataFrame, by: list[str], kinds: str, path: str) -> DataFrame:
    """(by, place, bidder) of groups of several blocks: edges (by, block, bidder, place, worth, places, most)."""
    spark = edges.sparkSession
    most, places = edges.agg(F.max("most"), F.max("places")).first()
    bidders = written(edges.select(*by, "block", "bidder").distinct(), f"{path}/bidders")
    price = spark.createDataFrame([], f"{kinds}, place long, price decimal(38,0)")
    nobody = spark.createDataFrame([], f"{kinds}, place long, price decimal(38,0), bidder long")
    i = 0

    def auction(epsilon: int):
        def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            known = frame.drop_duplicates("place")
            prices = {p: int(x) for p, x in zip(known["place"].tolist(), known["price"].tolist(), strict=True)}
            holder = {p: b for p, b in zip(known["place"].tolist(), known["holder"].tolist(), strict=True) if b >= 0}
            own = _edges(frame, places + 1)
            taken = sorted(_bids(own, prices, holder, sorted(set(own) - set(holder.values())), epsilon))
            out = pd.DataFrame({"place": pd.Series(taken, dtype="int64"), "price": [Decimal(prices[p]) for p in taken], "bidder": pd.Series([holder[p] for p in taken], dtype="int64")})
            for b, k in zip(by, key, strict=False):
                out[b] = k
            return out[[*by, "place", "price", "bidder"]]

        return run

    state = nobody
    for epsilon in _steps(int(most), int(places)):
        state = nobody
        while True:
            free = joined(bidders, state.select(*by, "bidder"), [*by, "bidder"], "left_anti")
            busy = written(free.select(*by, "block").distinct(), f"{path}/busy{i}")
            if busy.isEmpty():
                break
            now = joined(joined(edges, busy, [*by, "block"], "left_semi"), price, [*by, "place"], "left")
            now = joined(now, state.select(*by, "place", F.col("bidder").alias("holder")), [*by, "place"], "left")
            now = now.withColumn("price", F.coalesce("price", F.lit(0).cast("decimal(38,0)"))).withColumn("holder", F.coalesce("holder", F.lit(-1).cast("long")))
            bids = now.groupBy(*by, "block").applyInPandas(auction(epsilon), f"{kinds}, place long, price decimal(38,0), bidder long")
            every = state.unionAll(bids).groupBy(*by, "place").agg(F.max(F.struct("price", "bidder")).alias("m"))
            state = written(every.select(*by, "place", "m.price", "m.bidder"), f"{path}/state{i}")
            price = price.unionAll(state.select(*by, "place", "price")).groupBy(*by, "place").agg(F.max("price").alias("price"))
            price = written(price, f"{path}/price{i}")
            i += 1
    return state.select(*by, "place", "bidder")

