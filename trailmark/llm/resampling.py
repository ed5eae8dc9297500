"""Importance resampling towards a target distribution, with an integer word dictionary.

Features are runs of 1 to `most` consecutive words, counted into hashed buckets of the documents and of the target texts. A document's weight is the mean
log ratio of its features' buckets; with Gumbel noise of its id added, the highest weights are a draw without replacement.

1. Texts are read once, in blocks of 512 KB. A block keeps its distinct words with their ids, 64-bit integers, its distinct n-grams as tuples of ids with
   their counts, and its texts as places in this list of tuples.
2. The dictionary holds each distinct word of all blocks with its id. Should two words ever have one id, which it shows, all is read again with other ids.
3. Counts are summed for each distinct tuple. Only then are a tuple's words looked up, joined by spaces and hashed, once for each distinct tuple of the corpus.
4. Counts by bucket give gains, gains go back to tuples, tuples to blocks, and a block adds them up for its rows.

A word or tuple that every block has is one row for each block, summed before it is shuffled, and a skewed key of plain joins, which are split.

Defined cases: a null or empty text has no feature, weight 0 and a score, and can't be drawn by the query (it has under 20 words); rows that repeat a doc_id keep a
row each, with the same noise; a null doc_id has the noise of the empty string and comes last among ties; rows that tie in score, id and text are ranked one after
another; an empty target counts 0 everywhere; an empty table gives an empty result; other columns are ignored. Texts of over 512 KB are
read in pieces that share `most` - 1 words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import U64, WIDE_ROWS, documents, fresh, save, work_dir

BUCKETS, LEAST_WORDS, PERCENT, SEED, SCALE = 10_000, 20, 10, 2024, 1000
_PIECE = 1 << 19
#: Bits of a row's place in its block, and of a block's place in its task.
_ROW, _BLOCK = 20, 22

#: Lower-cases A-Z and makes a space of every byte that belongs to no word: words are digits, letters and all beyond ASCII.
_PARTED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def _pieces(texts: list[str | None], overlap: int):
    """(row of each text, words of each text, words that each text repeats from the one before), of some MB in all; texts beyond are cut between words."""
    rows, lists, size = [], [], 0
    for r, t in enumerate(texts):
        own = (t or "").encode().translate(_PARTED)
        if rows and size + len(own) > _PIECE:
            yield rows, lists, [0] * len(rows)
            rows, lists, size = [], [], 0
        if len(own) <= _PIECE:
            rows.append(r)
            lists.append(own.split())
            size += len(own)
            continue
        at, before = 0, []
        while at < len(own):
            end = own.find(b" ", at + _PIECE)
            end = len(own) if end < 0 else end
            words = before + own[at:end].split()
            yield [r], [words], [len(before)]
            at, before = end, words[max(0, len(words) - overlap) :]
    if rows:
        yield rows, lists, [0] * len(rows)


def _packed(which: np.ndarray, owner: np.ndarray, n: int) -> bytes:
    """Tuples of texts in ascending order for each text, as compressed steps from one to the next."""
    kind = np.uint16 if n <= 1 << 16 else np.uint32
    return pa.Codec("zstd").compress(np.diff(which[np.lexsort((which, owner))].astype(kind), prepend=kind(0)).tobytes(), asbytes=True)


def _unpacked(raw: bytes, count: int, n: int) -> np.ndarray:
    kind = np.uint16 if n <= 1 << 16 else np.uint32
    return np.cumsum(np.frombuffer(pa.Codec("zstd").decompress(raw, count * kind().itemsize, asbytes=True), kind), dtype=kind)


def _grams(place: np.ndarray, size: np.ndarray, skip: np.ndarray, most: int):
    """(distinct tuples of places as rows padded with -1, tuple of each feature, text of each feature, by text)."""
    doc = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(place)) - (np.cumsum(size) - size)[doc]
    found, owners = [], []
    for k in range(1, most + 1):
        last = np.flatnonzero((at >= k - 1) & (at >= skip[doc]))  # a feature belongs to the piece that its last word is new in
        rows = np.full((len(last), most), -1, np.int64)
        for j in range(k):
            rows[:, j] = place[last - (k - 1) + j]
        found.append(rows)
        owners.append(doc[last])
    rows, owner = np.concatenate(found), np.concatenate(owners)
    if most == 1:
        tuples, which = np.arange(place.max() + 1 if len(place) else 0)[:, None], rows[:, 0]
    else:
        tuples, which = np.unique(rows, axis=0, return_inverse=True)
    return tuples, which.ravel(), owner


def word_id(word: Column, salt: str) -> Column:
    return F.xxhash64(F.concat(F.lit(salt), word))


def _blocks(most: int, salt: str):
    """Rows (target, doc_id, text) to blocks: rows, ids, words and features of each text, tuple of each feature, distinct words, and
    distinct tuples of ids (columns g0, g1, ..., null beyond a tuple's end; single words stand for themselves) with their counts.
    """

    def run(batches):
        base = TaskContext.get().partitionId() << _BLOCK
        count = 0
        for b in batches:
            target, ids, first = b.column("target"), b.column("doc_id"), {}
            for rows, lists, skip in _pieces(b.column("text").to_pylist(), most - 1):
                size, skip = np.array([len(x) for x in lists]), np.array(skip)
                coded = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
                tuples, which, owner = _grams(coded.indices.to_numpy().astype(np.int64), size, skip, most)
                wanted = target.to_numpy(zero_copy_only=False).astype(bool)[rows][owner]
                of = [np.bincount(which[x], minlength=len(tuples)) for x in (~wanted, wanted)]
                # Spark's hash of strings has the seed 42.
                known = np.array([xxhash.xxh64_intdigest(salt.encode() + x, 42) for x in coded.dictionary.to_pylist()] if most > 1 else [], U64).view(np.int64)
                grams = [pa.array(known[t], mask=t < 0) if len(known) else pa.array([], pa.int64()) for t in tuples.T] if most > 1 else []
                block = base + count
                count += 1
                # A text's pieces share the row number of the first one.
                row = np.array([first.setdefault(r, block << _ROW | k) for k, r in enumerate(rows)], np.int64)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                take = pa.array(rows)
                lists = [target.take(take), pa.array(row), ids.take(take), pa.array(size - skip), pa.array(np.bincount(owner, minlength=len(rows))), coded.dictionary.cast(pa.string()), *map(pa.array, of), *grams]
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([_packed(which, owner, len(tuples))], pa.binary()), *map(one, lists)], names=_block_names(most))

    return run


def _block_ddl(most: int) -> str:
    longs = ["of_docs", "of_target", *(f"g{k}" for k in range(most) if most > 1)]
    return "block long, which binary, target array<boolean>, row array<long>, doc_id array<long>, n_words array<long>, n_features array<long>, words array<string>, " + ", ".join(f"{c} array<long>" for c in longs)


def _block_names(most: int) -> list[str]:
    return [x.split()[0] for x in _block_ddl(most).split(", ")]


def _sums(batches):
    """Blocks with the `gains` of their tuples to (row, doc_id, n_words, n_features, gain) of their documents."""
    for b in batches:
        for i in range(b.num_rows):
            gains = b.column("gains")[i].values.to_numpy() if b.column("gains")[i].is_valid else np.zeros(0, np.int32)
            n = b.column("n_features")[i].values.to_numpy()
            which = _unpacked(b.column("which")[i].as_py(), int(n.sum()), len(gains))
            upto = np.concatenate(([0], np.cumsum(gains[which], dtype=np.int64)))
            ends = np.cumsum(n)
            keep = pa.array(~b.column("target")[i].values.to_numpy(zero_copy_only=False).astype(bool))
            columns = [*(b.column(c)[i].values for c in ("row", "doc_id", "n_words", "n_features")), pa.array(upto[ends] - upto[ends - n])]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=["row", "doc_id", "n_words", "n_features", "gain"])


def dictionary(blocks: DataFrame, salt: str, path: str) -> DataFrame:
    """(id, word) of the distinct words of all blocks."""
    return save(blocks.select(F.explode("words").alias("word")).distinct().select(word_id(F.col("word"), salt).alias("id"), "word"), path)


def spelled(grams: DataFrame, words: DataFrame, most: int) -> DataFrame:
    """grams (g0, g1, ...) with text: the tuple's words, joined by spaces."""
    for k in range(most):
        own = words.select(F.col("id").alias(f"g{k}"), F.col("word").alias(f"w{k}"))
        grams = grams.join(own, f"g{k}", "left" if k else "inner")
    return grams.withColumn("text", F.concat_ws(" ", *[f"w{k}" for k in range(most)])).drop(*[f"w{k}" for k in range(most)])


def weights(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """row, doc_id, n_words, n_features, weight of each row of docs (doc_id, text) against the texts of target (text); row is a number of the row's own."""
    path = work_dir(docs.sparkSession, "resampling")
    both = docs.select(F.lit(False).alias("target"), F.col("doc_id").cast("long").alias("doc_id"), "text").unionAll(target.select(F.lit(True), F.lit(None).cast("long"), "text"))
    for salt in ("", *"abcdefg"):
        blocks = save(both.mapInArrow(_blocks(most, salt), _block_ddl(most)), f"{path}/blocks{salt}", WIDE_ROWS)
        words = dictionary(blocks, salt, f"{path}/dictionary{salt}")
        if words.select("id").distinct().count() == words.count():
            break
    gram = [f"g{k}" for k in range(most)]
    listed = gram if most > 1 else ["words"]
    numbered = (lambda df: df) if most > 1 else lambda df: df.withColumn("g0", word_id(F.col("words"), salt)).drop("words")
    zipped = numbered(blocks.select(F.explode(F.arrays_zip(*listed, "of_docs", "of_target")).alias("x")).select("x.*"))
    counted = zipped.groupBy(*gram).agg(F.sum("of_docs").alias("s"), F.sum("of_target").alias("t"))
    bucket = F.crc32(F.encode("text", "utf-8")) % buckets
    grams = save(spelled(counted, words, most).select(*gram, bucket.alias("bucket"), "s", "t"), f"{path}/grams")
    counts = grams.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))  # a row for each bucket
    totals = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("S"), F.coalesce(F.sum("t"), F.lit(0)).alias("T")).first()
    of = lambda c: (F.col(c) + 1).cast("double")
    ratio = of("t") * F.lit(float(totals["S"] + buckets)) / (of("s") * F.lit(float(totals["T"] + buckets)))
    gains = counts.select("bucket", F.floor(SCALE * F.log(ratio)).cast("int").alias("gain"))
    known = grams.join(gains, "bucket").select(*[F.col(g).alias(f"k{g}") for g in gram], "gain")
    placed = numbered(blocks.select("block", F.posexplode(F.arrays_zip(*listed)).alias("f", "x")).select("block", "f", "x.*"))
    on = F.col("g0") == F.col("kg0")
    for g in gram[1:]:
        on = on & F.col(g).eqNullSafe(F.col(f"k{g}"))
    # A tuple's place in its block and its gain are one number, above and below 32 bits.
    packed = F.shiftleft(F.col("f").cast("long"), 32).bitwiseOR(F.col("gain").cast("long").bitwiseAND((1 << 32) - 1))
    found = save(placed.join(known, on).select("block", packed.alias("x")).groupBy("block").agg(F.sort_array(F.collect_list("x")).alias("x")).select("block", F.transform("x", lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int")).alias("gains")), f"{path}/gains", WIDE_ROWS)
    texts = blocks.select("block", "which", "target", "row", "doc_id", "n_words", "n_features").join(found, "block", "left")
    parts = texts.mapInArrow(_sums, "row long, doc_id long, n_words long, n_features long, gain long")
    every = parts.groupBy("row").agg(F.min("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")])
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("gain") / F.col("n_features"))).otherwise(0).cast("long")
    return every.select("row", "doc_id", "n_words", "n_features", weight.alias("weight"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 Gumbel) of an id: the same in every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def in_order(rows: DataFrame, by: list[Column], name: str, path: str) -> DataFrame:
    """rows with their place, from 1, in the order of `by`: ranges are sorted by themselves and start after all rows of the ranges before."""
    part, at, before = fresh(rows, "part", "at", "before")
    parted = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id())
    parted = save(parted, path)
    sizes = parted.groupBy(part).agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    starts = sizes.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    return parted.join(starts, part).withColumn(name, F.col(before) + F.col(at).bitwiseAND((1 << 33) - 1) + 1).drop(part, at, before)


def resample(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of docs; the drawn `percent` of those with `least_words` or more have ranks 1, 2, 3, ..., the others null."""
    path = work_dir(docs.sparkSession, "resampling")
    scored = save(weights(docs, target, most, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), f"{path}/scored")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("row")]
    ranked = in_order(able, order, "rank", f"{path}/ordered").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
