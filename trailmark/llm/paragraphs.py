"""Near-duplicate paragraphs by MinHash banding.

A paragraph is a line of at least LEAST_WORDS words, that is, any line that isn't blank; its set holds the hashes of its 5-word
shingles, or of its whole sequence where it has fewer words. Paragraphs of equal sets form a class at once. A set of fewer than
LEAST_LINKED shingles reaches the similarity with an equal one only, so its class needs no bands. For all others, bands of min-hashes, tuned for a recall of at least RECALL at a Jaccard similarity of
THRESHOLD, bring together candidates; a band's bucket of up to ALL_PAIRS classes is compared all with all. In a larger
one each class is compared with the bucket's first, and then with the one that has most links; links among its classes that this leaves out are found by the
token-group matrix of the n-gram join, over the components so far. So no link within a bucket is passed over, and thousands of near copies need
two comparisons for each band. Every candidate is verified by exact Jaccard similarity. Components of the links are clusters; in each, the
paragraph of least (doc_id, place) stays and all others are repeats.

Passages within longer lines, or over several, are found by windows of WINDOW words that begin at content-defined places: a word whose hash is the least of
some run of REACH words. A passage of REACH + WINDOW - 1 = 40 words holds one at least, wherever it stands. Windows are compared by equality of their words (one
edit takes a window of this length below the threshold); of equal ones that of least (doc_id, start) stays.

Removals are the code points that repeats cover. One of fewer words than asked for (LEAST_REMOVED in the query) stays: a short line that
many documents have is reported as a repeat, but taking it out would harm more than help.

Defined cases: null, empty and white-space texts have no paragraph; equal paragraphs within one document are repeats as well; a null doc_id
sorts last and so is never the one that stays unless alone; repeated rows give repeats of each other, but rows that agree in doc_id and text
are one place and keep or lose the same; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jaccard import links_between, verify
from .shared import U64, Words, components, distinct_sets, documents, fresh, mix, save, slices, text_buffer, work_dir
from .substrings import least_of_runs

LEAST_WORDS, THRESHOLD, RECALL, MOST_BANDS, ALL_PAIRS = 1, 0.8, 0.999, 10, 24
#: n of n + 1 shingles in common are a similarity of 0.8 from n = 4 on.
LEAST_LINKED = 4
#: Rounds in which the classes of a wide bucket are compared with the one that links most.
HUBS = 1
REACH, WINDOW, LEAST_REMOVED = 16, 25, 20
_LAST = (1 << 63) - 1


def tune_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most `most` bands that has the recall at the threshold."""
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands <= most:
            return bands, rows
    raise ValueError("no banding has that recall")


BANDS, ROWS = tune_bands()


class Lines:
    """Paragraphs of a slice of documents, with their sets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        breaks = np.flatnonzero(data == 0x0A) + 1
        cuts = np.unique(np.concatenate((offsets, breaks)))
        w = Words(data, cuts)
        words = np.diff(w.first_of_doc())
        self.doc = np.searchsorted(offsets, cuts[:-1], "right") - 1
        self.place = np.arange(len(self.doc)) - np.searchsorted(self.doc, self.doc)
        line, token = distinct_sets(*w.shingles(5))
        n = np.bincount(line, minlength=len(words))
        ends = np.cumsum(n)
        total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(token), dtype=U64)))
        key = mix(total[ends] - total[ends - n] + n.astype(U64))
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        self.start = chars[cuts[:-1]] - chars[offsets[self.doc]]
        last = cuts[1:] - (data[np.maximum(cuts[1:] - 1, 0)] == 0x0A if len(data) else 0)
        self.end = chars[last] - chars[offsets[self.doc]]
        self.use = np.flatnonzero(words >= LEAST_WORDS)
        self.words, self.n, self.ends, self.key, self.token = words, n, ends, key.view(np.int64), token

    def minhashes(self, lines: np.ndarray) -> np.ndarray:
        """BANDS * ROWS min-hashes of each of these lines."""
        if not len(lines):
            return np.zeros((0, BANDS * ROWS), U64)
        size = self.n[lines]
        at = np.repeat(self.ends[lines] - size - (np.cumsum(size) - size), size) + np.arange(size.sum())
        token, starts = self.token[at], np.cumsum(size) - size
        return np.stack([np.minimum.reduceat(mix(token ^ U64(0x9FB21C651E98DF25 * (i + 1) & (1 << 64) - 1)), starts) for i in range(BANDS * ROWS)], axis=1)


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, key, start, end) of the windows of a slice of documents; they run over line breaks."""
    w = Words(data, offsets)
    n = len(w.hash)
    none = np.zeros(0, np.int64)
    if n < max(REACH, WINDOW):
        return none, none, none, none
    # Low bits hold the word's place, so that the least value tells it; the first of equal hashes counts.
    low = least_of_runs((mix(w.hash) & ~U64((1 << 27) - 1)) | np.arange(n, dtype=U64), REACH)
    stop = w.first_of_doc()[1:]
    whole = np.arange(len(low)) + REACH <= stop[w.doc[: len(low)]]
    at = np.unique((low[whole] & U64((1 << 27) - 1)).astype(np.int64))
    at = at[at + WINDOW <= stop[w.doc[at]]]
    key = np.zeros(len(at), U64)
    for k in range(WINDOW):
        key = mix(key + w.hash[at + k])
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    base = chars[offsets[w.doc[at]]]
    return w.doc[at], key.view(np.int64), chars[w.start[at]] - base, chars[w.end[at + WINDOW - 1]] - base


def _lines(batch):
    data, offsets = text_buffer(batch.column("text"))
    for i, j in slices(offsets):
        yield i, j, Lines(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


_PLACES = "doc_id long, h long, place long, start long, end long, n_words long, key long"
_WINDOWS = "doc_id long, h long, start long, end long, key long"


def _batch(b, i, row, ddl, *values):
    at = pa.array(row + i)
    return pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("h").take(at), *(pa.array(v.astype(np.int64)) for v in values)], names=[c.split()[0] for c in ddl.split(", ")])


def _occurrences(batches):
    for b in batches:
        for i, _, x in _lines(b):
            u = x.use
            yield _batch(b, i, x.doc[u], _PLACES, x.place[u], x.start[u], x.end[u], x.words[u], x.key[u])


def _window_rows(batches):
    for b in batches:
        data, offsets = text_buffer(b.column("text"))
        for i, j in slices(offsets):
            row, key, start, end = windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield _batch(b, i, row, _WINDOWS, start, end, key)


def _bands(batches):
    """(band, key) of each class that another can link with, once a task."""
    seen: set[int] = set()
    for b in batches:
        for _, _, x in _lines(b):
            new, use = [], x.use[x.n[x.use] >= LEAST_LINKED]
            for line, key in zip(use.tolist(), x.key[use].tolist(), strict=True):
                if key not in seen:
                    seen.add(key)
                    new.append(line)
            new = np.array(new, np.int64)
            h = x.minhashes(new).reshape(len(new), BANDS, ROWS)
            band = np.zeros((len(new), BANDS), U64)
            for r in range(ROWS):
                band = mix(band + h[:, :, r])
            band = mix(band ^ np.arange(BANDS, dtype=U64))
            yield pa.RecordBatch.from_arrays([pa.array(band.ravel().view(np.int64)), pa.array(np.repeat(x.key[new], BANDS))], names=["band", "key"])


def _candidates(batches):
    """From rows in order of (band, key): pairs (a, b) with a < b, and the band of buckets over ALL_PAIRS, where a is the first key.

    At most ALL_PAIRS keys of a bucket are held.
    """
    band_now, held, wide = None, [], False

    def pairs(keys):
        return [(a, b, None) for i, b in enumerate(keys) for a in keys[:i]]

    for batch in batches:
        out = []
        for band, key in zip(batch.column("band").to_pylist(), batch.column("key").to_pylist(), strict=True):
            if band != band_now:
                if not wide and len(held) > 1:
                    out += pairs(held)
                band_now, held, wide = band, [key], False
            elif key == held[-1]:
                continue
            elif wide:
                out.append((held[0], key, band))
                held[1:] = [key]
            else:
                held.append(key)
                if len(held) > ALL_PAIRS:
                    out += [(held[0], k, band) for k in held[1:]]
                    held, wide = [held[0], key], True
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["a", "b", "band"])
    if not wide and len(held) > 1:
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs(held)], pa.int64()) for k in range(3)], names=["a", "b", "band"])


def _full_sets(batches):
    for b in batches:
        wanted = b.column("places").to_pylist()
        for i, j, x in _lines(b):
            first = np.searchsorted(x.doc, np.arange(j - i))
            count = np.bincount(x.doc, minlength=j - i)
            lines = np.array([first[d] + p for d in range(j - i) for p in wanted[i + d] if p < count[d]], np.int64)
            size = x.n[lines]
            at = np.repeat(x.ends[lines] - size - (np.cumsum(size) - size), size) + np.arange(size.sum()) if len(lines) else lines
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(x.token[at].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(x.key[lines]), pa.array(size.astype(np.int64)), tokens], names=["key", "n", "tokens"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")


def _links_with_hubs(members: DataFrame, groups: DataFrame, edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the classes of each wide bucket (band, key) with its hub, the class that has most links so far: of near copies, the original."""
    degree = edges.select(F.col("a").alias("key")).union(edges.select(F.col("b").alias("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("links"))
    known = members.join(groups, "key").join(degree, "key", "left").select("band", "key", "grp", F.coalesce("links", F.lit(0)).alias("links"))
    hubs = known.groupBy("band").agg(F.max(F.struct("links", "key", "grp")).alias("h")).where("h.links > 1").select("band", F.col("h.key").alias("b"), F.col("h.grp").alias("hub_grp"))
    return verify(known.join(hubs, "band").where("grp <> hub_grp").select(F.col("key").alias("a"), "b").distinct(), sets)


def paragraph_clusters(docs: DataFrame) -> DataFrame:
    """Every paragraph that has a near duplicate: doc_id, h (hash of the text), place, start, end (code points), n_words, component_id, removed.

    `removed` is false for the one that stays.
    """
    path = work_dir(docs.sparkSession, "paragraphs")
    docs = _keyed(docs)
    rows = save(docs.mapInArrow(_occurrences, _PLACES), f"{path}/rows")
    last = F.lit(_LAST)
    classes = save(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct(F.coalesce("doc_id", last).alias("d"), "place")).alias("first")), f"{path}/classes")

    bands = docs.select("text").mapInArrow(_bands, "band long, key long").repartition("band").sortWithinPartitions("band", "key")
    found = save(bands.mapInArrow(_candidates, "a long, b long, band long"), f"{path}/candidates")
    # One paragraph of each class that has candidates gives its set.
    named = found.select(F.col("a").alias("key")).union(found.select(F.col("b").alias("key"))).distinct()
    wanted = classes.join(named, "key").groupBy(F.col("first.d").alias("d")).agg(F.collect_set("first.place").alias("places"))
    sets = docs.withColumn("d", F.coalesce("doc_id", last)).join(wanted, "d").select("text", "places").mapInArrow(_full_sets, "key long, n long, tokens array<long>")
    sets = save(sets.dropDuplicates(["key"]), f"{path}/sets")
    edges = save(verify(found.select("a", "b").distinct(), sets), f"{path}/links")

    wide = found.where("band is not null")
    if not wide.isEmpty():
        members = save(wide.select("band", F.col("a").alias("key")).union(wide.select("band", F.col("b").alias("key"))).distinct(), f"{path}/members")
        for i in range(HUBS + 1):
            labels = components(edges, f"{path}/wide{i}").select(F.col("id").alias("key"), "root")
            groups = save(members.select("key").distinct().join(labels, "key", "left").select("key", F.coalesce("root", "key").alias("grp")), f"{path}/groups{i}")
            if i < HUBS:
                edges = edges.union(save(_links_with_hubs(members, groups, edges, sets), f"{path}/hubs{i}"))
        edges = edges.union(links_between(sets.join(groups.select("key"), "key"), groups, path, bound=False))

    labels = components(edges, f"{path}/all").select(F.col("id").alias("key"), "root")
    clusters = classes.join(labels, "key", "left").withColumn("root", F.coalesce("root", "key"))
    kept = clusters.groupBy("root").agg(F.sum("rows").alias("size"), F.min("first").alias("kept")).where("size > 1")
    named = save(clusters.join(kept, "root").select("key", "kept"), f"{path}/named")
    component = F.when(F.col("kept.d") < last, F.col("kept.d"))
    removed = ~((F.coalesce("doc_id", last) == F.col("kept.d")) & (F.col("place") == F.col("kept.place")))
    return rows.join(named, "key").select("doc_id", "h", "place", "start", "end", "n_words", component.alias("component_id"), removed.alias("removed"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """Every window of which there is an equal one of lesser (doc_id, start): doc_id, h, start, end, n_words.

    The first of each key is found by an aggregate that is combined before its shuffle; the join with it is a plain one, whose skewed keys are split.
    """
    path = work_dir(docs.sparkSession, "windows")
    rows = save(_keyed(docs).mapInArrow(_window_rows, _WINDOWS), f"{path}/rows")
    place = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("d"), "start")
    first = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min(place).alias("first")).where("rows > 1").select("key", "first")
    return rows.join(save(first, f"{path}/first"), "key").where(place != F.col("first")).select("doc_id", "h", "start", "end", F.lit(WINDOW).cast("long").alias("n_words"))


def _merged(spans: list, least_words: int) -> list[tuple[int, int]]:
    """Unions of spans (start, end, n_words) of one document that adjoin or overlap, of as many words at least."""
    out: list[list[int]] = []
    for s, e, n in sorted((x["start"], x["end"], x["n_words"]) for x in spans):
        if out and s <= out[-1][1] + 1:
            # The words of what overlaps aren't counted twice: a window never has fewer than a removal needs.
            out[-1][1:] = [max(out[-1][1], e), out[-1][2] + n if s >= out[-1][1] else max(out[-1][2], n)]
        else:
            out.append([s, e, n])
    return [(s, e) for s, e, n in out if n >= least_words]


def _merge(least_words: int):
    def run(batches):
        for b in batches:
            got = [_merged(x or [], least_words) for x in b.column("spans").to_pylist()]
            ends = [pa.array([[x[k] for x in r] for r in got], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), b.column("n_repeats"), b.column("component_ids"), *ends], names=["doc_id", "h", "n_repeats", "component_ids", "starts", "ends"])

    return run


def removals(docs: DataFrame, least_words: int = LEAST_REMOVED) -> DataFrame:
    """What each document that has a repeat loses: doc_id, h, n_repeats (paragraphs with a near duplicate), component_ids (theirs), starts, ends (of removals, in code points).

    Rows that agree in doc_id and text have one row here. A document's spans are as many as it has lines and windows.
    """
    found = save(paragraph_clusters(docs), f"{work_dir(docs.sparkSession, 'removals')}/lines")
    none = F.lit(None).cast("long")
    lines = found.select("doc_id", "h", "start", "end", "n_words", "component_id", "place", "removed")
    windows = repeated_windows(docs).select("doc_id", "h", "start", "end", "n_words", none.alias("component_id"), none.alias("place"), F.lit(True).alias("removed"))
    span = F.when(F.col("removed"), F.struct("start", "end", "n_words"))
    each = lines.union(windows).groupBy("doc_id", "h").agg(F.collect_set(span).alias("spans"), F.count_distinct("place").alias("n_repeats"), F.array_sort(F.collect_set("component_id")).alias("component_ids"))
    return each.mapInArrow(_merge(least_words), "doc_id long, h long, n_repeats long, component_ids array<long>, starts array<long>, ends array<long>")


def _cut(batches):
    for b in batches:
        out = []
        for text, starts, ends in zip(*(b.column(c).to_pylist() for c in ("text", "starts", "ends")), strict=True):
            for s, e in zip(reversed(starts or []), reversed(ends or []), strict=True):
                # A line that goes as a whole takes its line break along.
                whole = (s == 0 or text[s - 1] == "\n") and text[e : e + 1] == "\n"
                text = text[:s] + text[e + whole :]
            out.append(text)
        names = [c for c in b.schema.names if c not in ("starts", "ends")]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else b.column(c) for c in names], names=names)


def remove_paragraphs(docs: DataFrame, least_words: int = LEAST_REMOVED) -> DataFrame:
    """docs with their text less the removals; what stays keeps its order. Columns stay as they are."""
    id_, h, row = fresh(docs, "id", "h", "row")
    gone = removals(docs, least_words).where(F.size("starts") > 0).select(F.col("doc_id").alias(id_), F.col("h").alias(h), "starts", "ends")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(h))
    rest = [c for c in docs.columns if c.lower() not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias(row) if rest else F.lit(0).alias(row))
    joined = packed.join(gone, same, "left").select("doc_id", "text", row, "starts", "ends")
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema}
    out = joined.mapInArrow(_cut, ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", "text", row)))
    return out.select(*[F.col(c) if c.lower() in ("doc_id", "text") else F.col(f"{row}.`{c}`").alias(c) for c in docs.columns])


def op7_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: doc_id, n_chars, n_repeats, n_removed (code points), n_spans, component_ids."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    met = removals(docs).withColumnRenamed("doc_id", "id").withColumnRenamed("h", "h_")
    each = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    lengths = F.zip_with("starts", "ends", lambda s, e: e - s)
    joined = each.join(met, F.col("doc_id").cast("long").eqNullSafe(F.col("id")) & (F.col("h") == F.col("h_")), "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id", "n_chars", F.coalesce("n_repeats", zero).alias("n_repeats"), F.coalesce(F.aggregate(lengths, zero, lambda a, x: a + x), zero).alias("n_removed"),
        F.coalesce(F.size("starts").cast("long"), zero).alias("n_spans"), F.coalesce("component_ids", F.array().cast("array<long>")).alias("component_ids"),
    )
