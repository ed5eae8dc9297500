"""Product quantization of vectors with codebooks from filtering Lloyd.

A vector's components become integers, floor(4096 x), and are cut into equal parts. Each position of a part has a codebook of a few
entries, fitted by Lloyd's rounds: assign every part to its nearest entry, then move each entry to the floored mean of its parts.

Every partition puts its vectors into blocks and builds a kd-tree over each part of a block: boxes that halve the parts at the median of
their widest component, each with its parts' sum and number. The trees are written once and serve all rounds. A round goes down a tree level by level
with the entries that may still be nearest. An entry goes when the box's corner that is most in its favour is nearer to the entry that is
nearest to the box's centre; a box with one entry left gives its sum and number at once, without a look at its parts. Only leaves
compare parts one by one. All arithmetic is on whole numbers, so the bounds are exact and ties always go to the lower index.

The driver holds the codebooks (entries times components, whatever the number of rows) and gets one sum for each of their numbers in a round.

Defined cases: rows whose vector is null, empty or has null or non-finite components are dropped, and so are those whose length isn't that of the first
kept vector (by vec_id, nulls last, then by vector); this length has to be a multiple of the parts. A component of 16384 or more either way raises an error, as squares
would leave 64 bits. Rows that repeat a vec_id each count and keep a row; a null vec_id is kept, last in order; null labels are one label;
with fewer vectors than entries the codebooks are as short; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import save, work_dir

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors of one tree, and parts of one leaf.
BLOCK, LEAF = 4096, 16
_MOST = 1 << 26


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x)."""
    out = np.floor(np.asarray(x, np.float64) * SCALE)
    if out.size and np.abs(out).max() >= _MOST:
        raise ValueError(f"a component of {_MOST // SCALE} or more either way can't be encoded")
    return out.astype(np.int64)


class Tree:
    """A kd-tree over points (n, d): a complete binary tree, level by level, whose nodes are ranges of `order`."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.order = np.arange(n)
        bounds = [np.array([0, n])]
        while n >> (len(bounds) - 1) > LEAF:
            cut = []
            for a, b in zip(bounds[-1][:-1], bounds[-1][1:], strict=True):
                own = points[self.order[a:b]]
                axis = int(np.argmax(own.max(0) - own.min(0)))
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
                cut += [a, a + mid]
            bounds.append(np.array([*cut, n]))
        self.points = points[self.order]
        self.bounds = bounds
        self.low, self.high, self.sum = ([f.reduceat(self.points, b[:-1], axis=0) for b in bounds] for f in (np.minimum, np.maximum, np.add))

    def numbers(self) -> tuple[np.ndarray, ...]:
        """What `restored` needs: order, and the boxes and sums of all levels."""
        return (self.order.astype(np.int32), *(np.concatenate(x) for x in (self.low, self.high, self.sum)))

    @classmethod
    def restored(cls, points: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray) -> Tree:
        self = cls.__new__(cls)
        self.order, self.points, bounds = order, points[order], [np.array([0, len(points)])]
        while len(points) >> (len(bounds) - 1) > LEAF:
            b = bounds[-1]
            bounds.append(np.append(np.stack([b[:-1], b[:-1] + np.diff(b) // 2], 1).ravel(), len(points)))
        self.bounds = bounds
        at = np.cumsum([0, *(len(b) - 1 for b in bounds)])
        self.low, self.high, self.sum = ([x[i:j] for i, j in zip(at[:-1], at[1:], strict=True)] for x in (low, high, sums))
        return self

    def assigned(self, entries: np.ndarray, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Sums and numbers of the points nearest to each entry, and how many distances points needed; fills codes if given."""
        k, index = len(entries), np.arange(len(entries))
        sums, counts, looked = np.zeros_like(entries), np.zeros(k, np.int64), 0
        nodes, may = np.zeros(1, np.int64), np.ones((1, k), bool)
        for level, bound in enumerate(self.bounds):
            low, high = self.low[level][nodes], self.high[level][nodes]
            off = ((2 * entries[None] - (low + high)[:, None]) ** 2).sum(2)
            best = np.where(may, off, np.iinfo(np.int64).max).argmin(1)
            chosen = entries[best][:, None]
            corner = np.where(entries[None] > chosen, high[:, None], low[:, None])
            gap = ((entries[None] - corner) ** 2 - (chosen - corner) ** 2).sum(2)
            may &= (gap < 0) | ((gap == 0) & (index < best[:, None]))
            may[np.arange(len(nodes)), best] = True
            alone = may.sum(1) == 1
            np.add.at(sums, best[alone], self.sum[level][nodes[alone]])
            np.add.at(counts, best[alone], (bound[1:] - bound[:-1])[nodes[alone]])
            if codes is not None:
                for node, c in zip(nodes[alone], best[alone], strict=True):
                    codes[self.order[bound[node] : bound[node + 1]]] = c
            nodes, may = nodes[~alone], may[~alone]
            if level + 1 < len(self.bounds):
                nodes, may = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel(), np.repeat(may, 2, axis=0)
        if len(nodes):
            bound = self.bounds[-1]
            size = (bound[1:] - bound[:-1])[nodes]
            rows = np.repeat(bound[nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())
            allowed = np.repeat(may, size, axis=0)
            looked = int(allowed.sum())
            own = self.points[rows]
            near = np.where(allowed, ((own[:, None] - entries[None]) ** 2).sum(2), np.iinfo(np.int64).max).argmin(1)
            np.add.at(sums, near, own)
            counts += np.bincount(near, minlength=k)
            if codes is not None:
                codes[self.order[rows]] = near
        return sums, counts, looked


def _planted(dim: int, parts: int):
    """Rows (vec_id, label, vector) to rows of BLOCK vectors with their trees."""
    width = dim // parts

    def block(ids, labels, vectors):
        x = whole_numbers(np.concatenate(vectors).reshape(-1, dim))
        trees = [Tree(x[:, p * width : (p + 1) * width]).numbers() for p in range(parts)]
        order = np.concatenate([t[0] for t in trees])
        boxes = np.concatenate([np.concatenate(t[1:]).ravel() for t in trees])
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.concat_arrays(ids)), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.concat_arrays(labels)), *(pa.array([a.tobytes()], pa.binary()) for a in (x.astype(np.int32), order, boxes))],
            names=["ids", "labels", "points", "orders", "boxes"],
        )

    def run(batches):
        held, n = [], 0
        for b in batches:
            vectors = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            i = 0
            while i < b.num_rows:
                j = min(b.num_rows, i + BLOCK - n)
                held.append((b.column("vec_id").slice(i, j - i), b.column("label").slice(i, j - i), vectors[i:j]))
                n, i = n + j - i, j
                if n == BLOCK:
                    yield block(*zip(*held, strict=True))
                    held, n = [], 0
        if n:
            yield block(*zip(*held, strict=True))

    return run


def _read(batch: pa.RecordBatch, row: int, dim: int, parts: int):
    x = np.frombuffer(batch.column("points")[row].as_buffer(), np.int32).astype(np.int64).reshape(-1, dim)
    n, width = len(x), dim // parts
    orders = np.frombuffer(batch.column("orders")[row].as_buffer(), np.int32).reshape(parts, n)
    boxes = np.frombuffer(batch.column("boxes")[row].as_buffer(), np.int64).reshape(parts, 3, -1, width)
    return x, [Tree.restored(x[:, p * width : (p + 1) * width], orders[p], *boxes[p]) for p in range(parts)]


def _round(books: np.ndarray, dim: int):
    """Blocks to rows (part, entry, place, total, n), summed over an Arrow batch."""
    parts, k, width = books.shape

    def run(batches):
        for b in batches:
            total = np.zeros((parts, k, width + 1), np.int64)
            for row in range(b.num_rows):
                for p, tree in enumerate(_read(b, row, dim, parts)[1]):
                    sums, counts, _ = tree.assigned(books[p])
                    total[p, :, :width] += sums
                    total[p, :, width] += counts
            part, entry = (a.ravel() for a in np.meshgrid(np.arange(parts), np.arange(k), indexing="ij"))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, width + 1), pa.int32()), pa.array(total.ravel()))], names=["part", "entry", "total"])

    return run


def _encoded(books: np.ndarray, dim: int):
    parts, _, width = books.shape

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                x, trees = _read(b, row, dim, parts)
                codes = np.zeros((len(x), parts), np.int64)
                for p, tree in enumerate(trees):
                    own = np.zeros(len(x), np.int64)
                    tree.assigned(books[p], own)
                    codes[:, p] = own
                error = ((x.reshape(-1, parts, width) - books[np.arange(parts), codes]) ** 2).sum((1, 2))
                text = ["".join(f"{c:02x}" for c in r) for r in codes.tolist()]
                yield pa.RecordBatch.from_arrays([b.column("ids").slice(row, 1).flatten(), b.column("labels").slice(row, 1).flatten(), pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def encode_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of each kept row of vectors (vec_id, embedding, label), and the codebooks (parts, entries, components of a part)."""
    spark = vectors.sparkSession
    if entries > 256:
        raise ValueError("a code has two hex digits for each part, so 256 entries at most")
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).select(F.size("vector")).first()
    kind = vectors.schema["label"].dataType.simpleString()
    if first is None:
        return spark.createDataFrame([], f"vec_id long, label {kind}, code string, error long"), np.zeros((parts, 0, 0), np.int64)
    dim = first[0]
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    rows = rows.where(F.size("vector") == dim)
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    books = whole_numbers(np.array([r["vector"] for r in start])).reshape(-1, parts, dim // parts).transpose(1, 0, 2).copy()
    blocks = save(rows.mapInArrow(_planted(dim, parts), f"ids array<long>, labels array<{kind}>, points binary, orders binary, boxes binary"), work_dir(spark, "vector_codes"))
    for _ in range(rounds):
        parted = blocks.mapInArrow(_round(books, dim), "part long, entry long, total array<long>").select("part", "entry", F.posexplode("total").alias("place", "v"))
        for r in parted.groupBy("part", "entry").pivot("place", list(range(dim // parts + 1))).agg(F.sum("v")).collect():
            *sums, n = r[2:]
            if n:
                books[r["part"], r["entry"]] = np.array(sums) // n
    return blocks.mapInArrow(_encoded(books, dim), f"vec_id long, label {kind}, code string, error long"), books


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the error summed over rows of equal labels; partial sums keep a label of very many rows from being one task."""
    errors = coded.groupBy(F.col("label").alias("its")).agg(F.sum("error").alias("label_error"))
    return coded.join(errors, F.col("label").eqNullSafe(F.col("its"))).drop("its")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded = save(coded, work_dir(spark, "vector_codes_out"))
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
