"""What the operators of this subpackage share: work folders, text buffers, hashing, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent, as in tests on one machine, a temporary folder serves.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set, and no folder of one machine would do")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="trailmark-"))
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Settings while a table is written. Shuffle files go once the table is there; Arrow batches of fewer rows keep rows with long
#: texts or sets from filling a worker's memory.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


#: For rows of some hundred KB: a page and a row group are looked at after a few of them, else their buffers outgrow an executor. The usual codec
#: keeps outgrown buffers outside the heap until it is collected; this one doesn't.
WIDE_ROWS = {"compression": "zstd", "parquet.page.size.row.check.min": "4", "parquet.page.size.row.check.max": "4", "parquet.block.size.row.check.min": "4", "parquet.block.size.row.check.max": "16", "parquet.block.size": str(16 << 20)}


def save(df: DataFrame, path: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet and read it back: cuts the lineage and outlives lost executors."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        conf.set(k, v)
    try:
        df.write.mode("overwrite").options(**(options or {})).parquet(path)
    finally:
        for k, v in before.items():
            conf.set(k, v)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 300_000):
    """Row ranges [i, j) of at most `most` bytes each (or one row)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit (splitmix64's finalizer)."""
    x = np.asarray(x).astype(U64, copy=True)
    x += U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: 1 where a byte belongs to a word, 0 for U+0020 and U+0009 to U+000D.
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(1, n), U64)
    out[1:] = U64(base)
    return np.cumprod(out, dtype=U64)


class Words:
    """The words `[^ \\t-\\r]+` of a slice of documents, A-Z lower-cased.

    start, end: byte positions in data; doc: row of each word, ascending; hash: 64 bits of the word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = WORD_BYTE[data]
        begins = inside[1:-1] & ~inside[:-2]
        cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
        begins[cuts] = inside[1:-1][cuts]
        ends = inside[1:-1] & ~inside[2:]
        ends[cuts - 1] = inside[1:-1][cuts - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.data = data
        total = np.zeros(n + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * _powers(_BASE, n), out=total[1:], dtype=U64)
        self.hash = mix((total[self.end] - total[self.start]) * _powers(_INVERSE, n)[self.start] if n else total[:0])
        self.n_docs = len(offsets) - 1

    def first_of_doc(self) -> np.ndarray:
        """Index of each document's first word; one more entry at the end."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def shingles(self, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of all k-word shingles, in text order; shorter documents have their whole sequence as one."""
        h, doc = self.hash, self.doc
        if len(h) == 0:
            self.shingle_at = doc
            return doc, h
        first = self.first_of_doc()
        count = np.diff(first)
        n = len(h)
        out = np.zeros(n, U64)
        left = first[1:][doc] - np.arange(n)
        for i in range(min(k, n)):
            use = left > i
            part = np.zeros(n, U64)
            part[: n - i] = h[i:]
            out = np.where(use, mix(out * U64(_BASE) + part + U64(i + 1)), out)
        at = np.arange(n) - first[:-1][doc]
        keep = (left >= k) | ((count[doc] < k) & (at == 0))
        self.shingle_at = np.flatnonzero(keep)  # the word that each begins with
        return doc[keep], out[keep]


def distinct_sets(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, value) pairs, by doc and then value."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[keep], value[keep]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each lengthened until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def bounded_sample(rows: DataFrame, most: int, by: list[str]) -> DataFrame:
    """At most `most` of rows' different values of `by`, those of least hash, one row for each, whatever rows repeat them; the same for the same rows."""
    (h,) = fresh(rows, "h")
    hashed = rows.withColumn(h, F.xxhash64(*by))
    cut = hashed.select(h).distinct().orderBy(h).limit(most).agg(F.max(h)).first()[0]
    return hashed.where(F.col(h) <= F.lit(cut)).dropDuplicates([h]).drop(h) if cut is not None else rows.limit(0)


#: Bits of a sieve's table, at most; 64 of them are a row, so 262,144 rows are broadcast.
MOST_BITS = 1 << 24


def sieve(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose `column` may be among keys (one column of that name and type, with repeats or not); none that is among them is lost.

    Each key sets one bit of a broadcast table, and rows whose bit isn't set are left out, so that a join with keys needn't shuffle what they carry. The
    table is bounded: with more keys than it has bits it lets more rows pass, and the join that follows decides in any case. That join is an inner one, as Spark carries out a semi join
    before the sieve.
    """
    bits = 64
    most = min(MOST_BITS, 16 * keys.count())
    while bits < most:
        bits *= 2
    word, here = fresh(rows, "word", "here")
    slot = f"pmod(xxhash64(`{column}`), {bits}L)"
    table = keys.groupBy(F.expr(f"shiftright({slot}, 6)").alias(word)).agg(F.expr(f"bit_or(shiftleft(1L, cast({slot} & 63 as int)))").alias(here))
    met = rows.withColumn(word, F.expr(f"shiftright({slot}, 6)")).join(F.broadcast(table), word)
    return met.where(F.expr(f"shiftright({here}, cast({slot} & 63 as int)) & 1 = 1")).select(*rows.columns)


def components(edges: DataFrame, path: str, rounds: int = 60) -> DataFrame:
    """(id, root) for each vertex of edges (a, b) between longs: equal roots, same component.

    Each round lets every vertex join its neighbour (or itself) of least hash and carries the
    edges over to what was joined; hash order makes long chains shrink by a share every round.
    The minimum is pre-aggregated before the shuffle, so a hub is no hot key there. What was joined is followed up at the end,
    in one job for every eight rounds.
    """
    spark = edges.sparkSession
    edges = save(edges.where("a <> b").select("a", "b").distinct(), f"{path}/edges0")
    labels, parents = None, []

    def followed(at: str) -> DataFrame:
        out = labels
        for parent in parents:
            up = parent.select(F.col("id").alias("root"), F.col("root").alias("up"))
            out = parent if out is None else out.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root"))
        return out if labels is None and len(parents) < 2 else save(out, at)

    for i in range(rounds):
        if edges.isEmpty():
            break
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        parent = both.groupBy("a").agg(F.min(F.least(rank("a"), rank("b"))).alias("m")).select(F.col("a").alias("id"), F.col("m.v").alias("root"))
        parents.append(parent := save(parent, f"{path}/parent{i}"))
        nxt = (
            edges.join(parent.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a")
            .join(parent.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
        edges = save(nxt, f"{path}/edges{i + 1}")
        if len(parents) == 8:
            labels, parents = followed(f"{path}/labels{i}"), []
    else:
        raise RuntimeError("components: not finished")
    if parents:
        labels = followed(f"{path}/labels")
    return labels if labels is not None else spark.createDataFrame([], "id long, root long")
