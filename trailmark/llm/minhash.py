"""Near-duplicate documents by many universal hash minima, banding, verification and star components.

A document's set holds the hashes of its distinct 2-word shingles. Documents of equal sets form a class, keyed by a 64-bit hash of the set;
everything below is on classes.

1. Signature: the minima of BANDS * ROWS functions (a x + b mod 2^64) >> 32 over the set, with odd a and any b.
2. Banding: the ROWS minima of each band are a bucket. Two sets of similarity s share one of their buckets with probability 1 - (1 - s^ROWS)^BANDS; at
   0.8 that misses 5 in 10^7.
3. Candidates of a bucket: each class with the bucket's first class by hash, then with twice as many in every pass, in so far as their groups (what
   is linked so far) differ. What is in one group needs no further comparison, so thousands of near copies cost a few comparisons each. When passes find little,
   all pairs of a bucket that are still in different groups follow, so no link is left out; but many copies, each with edits of its own, make very many such
   pairs that fall just short. Of two sets of n and m shingles that link, at least 4 (n + m) / 9 are common. So with shingles in one order, those that occur
   in few classes first, two sets that link have their first common shingle early in both: pairs are made from these first shingles, and then have to share a bucket.
4. Verification: pairs whose signatures agree in under LEAST_AGREE of the minima go (at 0.8, less than two in 10^7 do); the others are
   compared on their full sets.
5. Components of the links by alternating large-star and small-star steps, each a grouped minimum and a join, until nothing changes.

Defined cases: null, empty and white-space texts have no shingle, are linked with nothing and are kept; one word is one shingle; repeated rows are
linked; a null doc_id keeps its row (its component is the least id linked to it, or null, and then the row is kept); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .jaccard import least_common, verify
from .shared import U64, Words, distinct_sets, documents, mix, save, slices, text_buffer, work_dir

SHINGLE, ROWS, BANDS = 2, 6, 48
LEAST_AGREE = 0.66
#: Passes with 1, 2, 4, ... firsts of each bucket, and the share of the classes that a pass has to link for another one of its kind.
PASSES, WORTH = 4, 0.05
_A = mix(np.arange(BANDS * ROWS)) | U64(1)
_B = mix(np.arange(BANDS * ROWS) + (1 << 32))


def _sets(data: np.ndarray, offsets: np.ndarray):
    """(tokens by text, size and key of each text's set)."""
    doc, token = distinct_sets(*Words(data, offsets).shingles(SHINGLE))
    n = np.bincount(doc, minlength=len(offsets) - 1)
    ends = np.cumsum(n)
    total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(token), dtype=U64)))
    return token, n, mix(total[ends] - total[ends - n] + n.astype(U64))


def signatures(token: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Minima (one row for each set that isn't empty) of token's hashes under each function."""
    x = token >> U64(32)
    some = n[n > 0]
    starts = np.cumsum(some) - some
    out, h = np.empty((len(some), len(_A)), np.uint32), np.empty_like(x)
    if len(some):
        for i, (a, b) in enumerate(zip(_A, _B, strict=True)):
            np.multiply(x, a, out=h)
            h += b
            out[:, i] = np.minimum.reduceat(h, starts) >> U64(32)
    return out


def _first_met(seen: set[int], key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which sets aren't empty and haven't been met in this task."""
    new = np.zeros(len(key), bool)
    for i, (k, m) in enumerate(zip(key.tolist(), n.tolist(), strict=True)):
        if m and k not in seen:
            seen.add(k)
            new[i] = True
    return new


def _describe(batches):
    """(doc_id, h, n, key, signature); a set that the task has met before has no signature again."""
    seen: set[int] = set()
    for b in batches:
        data, offsets = text_buffer(b.column("text"))
        for i, j in slices(offsets):
            token, n, key = _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            new = _first_met(seen, key, n)
            own = signatures(token[np.repeat(new, n)], n[new])
            raw = np.full(j - i, None, object)
            raw[new] = [r.tobytes() for r in own]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("h").slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(key.view(np.int64)), pa.array(raw.tolist(), pa.binary())], names=["doc_id", "h", "n", "key", "signature"])


def _full_sets(batches):
    """(key, n, tokens) of texts, once for each set that a task meets."""
    seen: set[int] = set()
    for b in batches:
        data, offsets = text_buffer(b.column("text"))
        for i, j in slices(offsets):
            token, n, key = _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            new = _first_met(seen, key, n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n[new]))).astype(np.int32)), pa.array(token[np.repeat(new, n)].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(n[new].astype(np.int64)), lists], names=["key", "n", "tokens"])


def _agreeing(batches):
    for b in batches:
        one, two = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS) for c in ("sa", "sb"))
        same = one == two
        keep = pa.array((same.mean((1, 2)) >= LEAST_AGREE) & same.all(2).any(1))
        yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])


def agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys whose signatures agree in LEAST_AGREE of the minima at least, and in a whole band."""
    of = lambda k, s: classes.select(F.col("key").alias(k), F.col("signature").alias(s))
    return pairs.join(of("a", "sa"), "a").join(of("b", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(_agreeing, "a long, b long")


def stars(edges: DataFrame, path: str, rounds: int = 100) -> DataFrame:
    """(id, root) for each vertex of edges (a, b) between longs, root the least vertex of its component.

    Large star: every vertex hands its larger neighbours to the least vertex it knows. Small star: every vertex hands its smaller neighbours, and itself, to the least of
    them. Components stay as they are under both, and in the end each is one star around its least vertex.
    """
    tied = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    e = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{path}/star0")
    before = tied(e)
    for i in range(rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = save(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{path}/large{i + 1}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        e = save(small.distinct(), f"{path}/star{i + 1}")
        now = tied(e)
        if now == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError("stars: not finished")


def _candidates(buckets: DataFrame, i: int) -> DataFrame:
    """Pairs (a, b) of different groups in a bucket, and of sizes that can link: its classes with 2^i firsts of the bucket."""
    one = buckets.select("bucket", F.col("key").alias("a"), F.col("n").alias("na"), "grp")
    drawn = buckets.withColumn("draw", F.explode(F.sequence(F.lit(1 << i), F.lit((2 << i) - 1))))
    first = drawn.groupBy("bucket", "draw").agg(F.min(F.struct(F.xxhash64("key", "draw").alias("rank"), "key", "n", "grp")).alias("x"))
    two = first.select("bucket", F.col("x.key").alias("b"), F.col("x.n").alias("nb"), F.col("x.grp").alias("other")).distinct()
    met = one.join(two, "bucket").where(f"grp <> other and {_SIZES}")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _placed(buckets: DataFrame, sets: DataFrame, path: str) -> DataFrame:
    """(key, n, token, place) of classes in buckets: shingles that several groups have, with their place, rare ones first.

    Shingles of one group only can't be common with another group's; they come first. Only places that the first common shingle can have are kept.
    """
    rows = save(sets.join(buckets.select("key", "grp").distinct(), "key").select("key", "n", "grp", F.explode("tokens").alias("token")), f"{path}/tokens")
    met = rows.groupBy("token").agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.count(F.lit(1)).alias("classes")).where("low <> high").select("token", "classes")
    mine = Window.partitionBy("key").orderBy("classes", "token")
    whole = mine.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = rows.join(met, "token").select("key", "n", "token", F.row_number().over(mine).alias("at"), F.count(F.lit(1)).over(whole).alias("common"))
    told = told.where(F.col("common") >= least_common(F.col("n"))).withColumn("place", F.col("n") - F.col("common") + F.col("at"))
    return save(told.where(F.col("place") <= F.col("n") - least_common(F.col("n")) + 1).select("key", "n", "token", "place"), f"{path}/places")


#: What sizes, places of a common shingle, and shingles in common with other groups allow to link.
_SIZES = "na * 100 >= nb * 80 and nb * 100 >= na * 80"
_FITS = f"grp <> other and {_SIZES} and (na < nb or na = nb and a < b) and (1 + least(na - pa, nb - pb)) * 9 >= (na + nb) * 4"


def _rest(places: DataFrame, buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different groups whose first common shingle may stand where it has to stand in two sets that link. The smaller set's is among its first n / 9 + 1."""
    now = places.join(buckets.select("key", "grp").distinct(), "key")
    one = now.where("place * 9 <= n + 9").select("token", F.col("key").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), "grp")
    two = now.select("token", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("grp").alias("other"))
    return one.join(two, "token").where(_FITS).select("a", "b").distinct()


def _several(buckets: DataFrame, path: str) -> DataFrame:
    """The rows of buckets that hold several groups."""
    buckets = save(buckets, f"{path}/all_buckets")
    several = buckets.groupBy("bucket").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low <> high").select("bucket")
    return save(buckets.join(several, "bucket", "left_semi"), f"{path}/buckets")


def links(docs: DataFrame, classes: DataFrame, path: str) -> DataFrame:
    """Links (a, b) of classes (key, n, signature, h) that hold a spanning forest of all that share a bucket and have a similarity of 0.8 at least."""
    spark = docs.sparkSession
    band = F.substring("signature", F.col("band") * (4 * ROWS) + 1, F.lit(4 * ROWS))
    banded = classes.select("key", "n", "signature", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")).select("key", "n", F.xxhash64("band", band).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("bucket")
    buckets = save(banded.join(shared, "bucket", "left_semi").withColumn("grp", F.col("key")), f"{path}/buckets")
    open_ = save(buckets.select("key").distinct().join(classes, "key").select("key", "h", "signature"), f"{path}/open")
    n_open = open_.count()
    edges = spark.createDataFrame([], "a long, b long")
    if not n_open:
        return edges
    texts = docs.join(open_.select("h").distinct(), "h", "left_semi").select("text").mapInArrow(_full_sets, "key long, n long, tokens array<long>")
    sets = save(texts.join(open_.select("key"), "key", "left_semi").dropDuplicates(["key"]), f"{path}/sets")
    for i in range(PASSES):
        at = f"{path}/pass{i}"
        found = save(verify(agreeing(_candidates(buckets, i), open_), sets), f"{at}/found")
        edges, n_found = edges.unionAll(found), found.count()
        if n_found:
            groups = stars(edges, at).select(F.col("id").alias("key"), F.col("root").alias("grp"))
            moved = buckets.drop("grp").join(groups, "key", "left").select("key", "n", "bucket", F.coalesce("grp", "key").alias("grp"))
            buckets = _several(moved, at)
        if i == 0:
            places = _placed(buckets, sets, at)
            buckets = _several(buckets.join(places.select("key").distinct(), "key", "left_semi"), f"{at}/able")
        if n_found < WORTH * n_open:
            break
    return edges.unionAll(save(verify(agreeing(_rest(places, buckets), open_), sets), f"{path}/rest"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs (doc_id, text)."""
    path = work_dir(docs.sparkSession, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    rows = save(docs.mapInArrow(_describe, "doc_id long, h long, n long, key long, signature binary"), f"{path}/rows")
    classes = save(rows.where("n > 0").groupBy("key").agg(F.min("n").alias("n"), F.min("doc_id").alias("least"), F.min(F.when(F.col("signature").isNotNull(), F.col("h"))).alias("h"), F.max("signature").alias("signature")), f"{path}/classes")
    labels = stars(links(docs.select("text", "h"), classes, path), f"{path}/all")
    rooted = classes.select("key", "least").join(labels.select(F.col("id").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = rooted.join(least, "root").select("key", "component_id")
    some = rows.where("n > 0").select("doc_id", "n", "key").join(names, "key").select("doc_id", "n", "component_id")
    every = some.unionAll(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
