"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of words (A-Z lower-cased). A five-word shingle of an item is a seed; where a
document has one, the pair is a candidate. Running Karp-Rabin greedy string tiling then marks, again and again, the longest
matches that overlap no marked word, down to five words; a search length that halves from the longest expected match keeps the hash tables small, and only
places that start with a seed are looked at. A document is contaminated by an item whose words
its tiles cover to COVERAGE or more, in whatever order the passages come.

Where the benchmark has at most MOST_SEEDS shingles (about 100 MB), it is broadcast and documents are read once, without a
shuffle. A larger one is joined on the seeds instead, and only the candidates' texts are shuffled. Its rows go by hashes of id and
text, so that null and repeated ids are told apart; as each candidate's own text is tiled, two rows of one hash cost time only.

Defined cases: null and empty texts are clean; an item without words contaminates nothing, one of fewer than five words only a
document of just these words; repeated items and rows give a row each; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Words, documents, fresh, save, slices, text_buffer, work_dir

LEAST, COVERAGE, MOST_SEEDS, MOST_BYTES = 5, 0.5, 1_000_000, 64_000_000


def greedy_tiles(item: list[int], text: list[int], places: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (length, place in item, place in text); places: where the text's seeds begin.

    Both may be shorter than `least`; then they tile if they are equal.
    """
    if len(item) < least:
        return [(len(item), 0, 0)] if item == text else []
    free_i, free_t = bytearray(b"\1") * len(item), bytearray(b"\1") * len(text)
    tiles = []

    def extend(i: int, t: int) -> int:
        k = 0
        while i + k < len(item) and t + k < len(text) and item[i + k] == text[t + k] and free_i[i + k] and free_t[t + k]:
            k += 1
        return k

    length = max(least, len(item) // 2)
    while True:
        table = defaultdict(list)
        for i in range(len(item) - length + 1):
            if all(free_i[i : i + length]):
                table[hash(tuple(item[i : i + length]))].append(i)
        found, longest = [], 0
        for t in places:
            if t + length <= len(text) and all(free_t[t : t + length]):
                for i in table.get(hash(tuple(text[t : t + length])), ()):
                    # A match is taken from its first word only.
                    if i and t and item[i - 1] == text[t - 1] and free_i[i - 1] and free_t[t - 1]:
                        continue
                    k = extend(i, t)
                    if k >= length:
                        found.append((k, i, t))
                        longest = max(longest, k)
        if longest > 2 * length:
            length = longest
            continue
        for k, i, t in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if all(free_i[i : i + k]) and all(free_t[t : t + k]):
                free_i[i : i + k] = free_t[t : t + k] = bytes(k)
                tiles.append((k, i, t))
        if any(_rest(free_i, free_t, i, t, k) >= length for k, i, t in found):
            continue  # what a mark has cut off may still be as long
        if length == least:
            return tiles
        length = max(least, length // 2)


def _rest(free_i, free_t, i: int, t: int, k: int) -> int:
    """Longest run of a match that is still free on both sides."""
    best = run = 0
    for j in range(k):
        run = run + 1 if free_i[i + j] and free_t[t + j] else 0
        best = max(best, run)
    return best


def _seeds(batches):
    for b in batches:
        data, offsets = text_buffer(b.column("text"))
        row, seed = Words(data, offsets).shingles(LEAST)
        yield pa.RecordBatch.from_arrays([b.column("i").take(pa.array(row)), pa.array(seed.view(np.int64))], names=["i", "seed"])


class Items:
    """Benchmark items in memory: seeds in order, and each one's items."""

    def __init__(self, ids: list, texts: list):
        data, offsets = text_buffer(pa.array(texts, pa.string()))
        w = Words(data, offsets)
        first = w.first_of_doc()
        self.ids, words = ids, w.hash.tolist()
        self.words = [words[first[i] : first[i + 1]] for i in range(len(ids))]
        row, seed = w.shingles(LEAST)
        order = np.argsort(seed, kind="stable")
        self.seeds, self.rows = seed[order], row[order]

    def tile(self, words: Words, i: int, first: np.ndarray, at: np.ndarray, seed: np.ndarray, only: set | None = None):
        """(number of the item, covered words, tiles) for each candidate item of document i; at, seed: the document's seeds and their places in words."""
        lo, hi = np.searchsorted(self.seeds, seed, "left"), np.searchsorted(self.seeds, seed, "right")
        places = defaultdict(list)
        for a, x, y in zip((at - first[i]).tolist(), lo.tolist(), hi.tolist(), strict=True):
            for r in set(self.rows[x:y].tolist()):
                places[r].append(a)
        text = words.hash[first[i] : first[i + 1]].tolist() if places else []
        for r in sorted(places):
            if only is None or self.ids[r] in only:
                tiles = greedy_tiles(self.words[r], text, places[r])
                yield r, sum(k for k, _, _ in tiles), len(tiles)


def _matches(batch, items: Items):
    """(row, number of the item, covered, tiles) of the contaminated rows of a batch."""
    data, offsets = text_buffer(batch.column("text"))
    for i, j in slices(offsets):
        w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        doc, seed = w.shingles(LEAST)
        if not len(seed) or not len(items.seeds):
            continue
        place = np.minimum(np.searchsorted(items.seeds, seed), len(items.seeds) - 1)
        hit = np.flatnonzero(items.seeds[place] == seed)
        first = w.first_of_doc()
        for d in np.unique(doc[hit]).tolist():
            mine = hit[np.searchsorted(doc[hit], d) : np.searchsorted(doc[hit], d, "right")]
            for r, covered, tiles in items.tile(w, d, first, w.shingle_at[mine], seed[mine]):
                if covered >= COVERAGE * len(items.words[r]):
                    yield i + d, r, covered, tiles


_OUT = "doc_id long, item_id long, item_words long, covered_words long, n_tiles long, coverage double"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _report(items_of):
    def run(batches):
        items = items_of()
        for b in batches:
            found = list(_matches(b, items))
            n = [len(items.words[r]) for _, r, _, _ in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array([x[0] for x in found], pa.int64())), pa.array([items.ids[x[1]] for x in found], pa.int64()), pa.array(n, pa.int64()), pa.array([x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.int64()), pa.array([x[2] / m for x, m in zip(found, n, strict=True)], pa.float64())],
                names=_NAMES,
            )

    return run


def _drop(items_of):
    def run(batches):
        items = items_of()
        for b in batches:
            bad = {x[0] for x in _matches(b, items)}
            yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_())) if bad else b

    return run


def _pairs(batches):
    """Rows (doc_id, text, item_id, item_text), each tiled by itself. Gives the SHA-256 of the text as well."""
    for b in batches:
        out = []
        for i, (item_id, text) in enumerate(zip(b.column("item_id").to_pylist(), b.column("item_text").to_pylist(), strict=True)):
            items = Items([item_id], [text or ""])
            out += [(i, item_id, len(items.words[0]), c, t) for _, _, c, t in _matches(b.slice(i, 1), items)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array([x[0] for x in out], pa.int64())), *(pa.array([x[k] for x in out], pa.int64()) for k in (1, 2, 3, 4)), pa.array([x[3] / x[2] for x in out], pa.float64()), b.column("sha").take(pa.array([x[0] for x in out], pa.int64()))], names=[*_NAMES, "sha"])


def _doc_seeds(batches):
    for b in batches:
        data, offsets = text_buffer(b.column("text"))
        for i, j in slices(offsets):
            doc, seed = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).shingles(LEAST)
            yield pa.RecordBatch.from_arrays([b.column("d").slice(i, j - i).take(pa.array(doc)), pa.array(seed.view(np.int64))], names=["d", "seed"])


def _small(benchmark: DataFrame, most_seeds: int):
    """A function that gives the broadcast items, or None where there are too many."""
    words = F.size(F.split("text", r"[\x20\x09-\x0D]+"))
    n, rows, size = benchmark.agg(F.sum(F.when(F.col("text").isNotNull(), words)), F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    if (n or 0) > most_seeds or rows > most_seeds or (size or 0) > MOST_BYTES:
        return None
    rows = benchmark.collect()  # at most most_seeds rows and words, and MOST_BYTES
    sent = benchmark.sparkSession.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] or "" for r in rows]))
    return lambda: Items(*sent.value)


def _joined(docs: DataFrame, benchmark: DataFrame, once: bool = False) -> DataFrame:
    """The report on docs (d, doc_id, text), and sha, where d is a hash of the row; once: one row stands for all of equal d and text."""
    benchmark = benchmark.withColumn("i", F.xxhash64("item_id", "text"))
    seeds = benchmark.select("i", "text").mapInArrow(_seeds, "i long, seed long").distinct()
    pairs = docs.select("d", "text").mapInArrow(_doc_seeds, "d long, seed long").distinct().join(seeds, "seed").select("d", "i").distinct()
    pairs = save(pairs, work_dir(docs.sparkSession, "contamination"))
    texts = docs.join(pairs.select("d").distinct(), "d", "left_semi").withColumn("sha", F.sha2("text", 256))
    if once:
        texts = texts.groupBy("d", "sha").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    rows = pairs.join(texts, "d").join(benchmark.withColumnRenamed("text", "item_text"), "i")
    return rows.select("doc_id", "text", "item_id", "item_text", "sha").mapInArrow(_pairs, f"{_OUT}, sha string")


def contaminated(docs: DataFrame, benchmark: DataFrame, most_seeds: int = MOST_SEEDS) -> DataFrame:
    """One row for each document and item that contaminates it: doc_id, item_id, item_words, covered_words, n_tiles, coverage."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    items_of = _small(benchmark, most_seeds)
    if items_of:
        return docs.mapInArrow(_report(items_of), _OUT)
    return _joined(docs.withColumn("d", F.xxhash64("doc_id", "text")), benchmark).select(*_NAMES)


def clean(docs: DataFrame, benchmark: DataFrame, most_seeds: int = MOST_SEEDS) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns."""
    items_of = _small(benchmark, most_seeds)
    if items_of:
        return docs.mapInArrow(_drop(items_of), docs.schema)
    # A text decides by itself whether its row goes.
    texts = docs.select(F.xxhash64("text").alias("d"), F.lit(None).cast("long").alias("doc_id"), "text")
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    (sha,) = fresh(docs, "sha")
    bad = _joined(texts, benchmark, once=True).select(F.col("sha").alias(sha)).distinct()
    return docs.join(bad, F.sha2(F.col("text"), 256) == F.col(sha), "left_anti").select(*docs.columns)


def op2_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
