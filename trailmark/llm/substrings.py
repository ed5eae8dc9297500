"""Removal of byte strings of 50 or more that an earlier document has, by prefix-free parsing.

A rolling hash of 24 bytes picks triggers: in every 50-byte string the 24-byte window of least hash. Consecutive
50-byte strings with one trigger form a phrase, so equal strings have equal triggers at equal places, and a text is parsed
into phrases that overlap as in prefix-free parsing. The dictionary holds the distinct phrases, the parse their occurrences
(document, place). In corpus order, sorted by trigger, phrase and document, each phrase's first document comes first:

* an occurrence in a later document is covered whole, all its 50-byte strings are in the first one;
* where one trigger has several phrases, these are cut into their dictionary suffixes of 50 bytes, which are put in order in the same
  way. So only those few, and only of each phrase's first document, are ever looked at string by string.

Suffixes are compared up to 50 bytes only, which the parse's windows hold whole, so the suffix array of the parse isn't needed beyond that.
Within a slice of documents, occurrences that are already known to be covered are told apart before the shuffle; copies therefore travel
as one range each. Phrases and 50-byte strings are compared by 48 + 56 bits of hash.

Defined cases: a null text is an empty one; documents of under 50 bytes lose nothing and cover nothing; rows that repeat a doc_id
don't cover one another and each keep a row; a null doc_id counts as greater than all others; other columns are ignored. A text of over 64 MB is
parsed in pieces that overlap by 49 bytes. Rows of one doc_id are told apart by the place of their text's SHA-256 among that id's (up to 2^26 different ones).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import _BASE, _INVERSE, U64, _powers, documents, mix, save, slices, text_buffer, work_dir

LENGTH, TRIGGER = 50, 24
_MOST = (1 << 63) - 1
#: Low bits of the values whose minimum is taken hold the place in a piece of a text, of at most half as many bytes.
_PLACE = 27
_SLICE, _PIECE = 1 << 20, 1 << 26
#: Bits of the number that tells rows of one doc_id apart; a place in a text has 31 above them.
_TAG = 26
_AT = _TAG + 6


def _rolled(data: np.ndarray) -> np.ndarray:
    """Hash of the TRIGGER bytes from each place on: by doubling, pieces put together as TRIGGER's bits say."""
    power = lambda k: U64(pow(_BASE, k, 1 << 64))
    piece, width, out, have = mix(np.arange(256))[data], 1, None, 0
    while True:
        if TRIGGER & width:
            out = piece if out is None else piece[: len(piece) - have] * power(have) + out[width:]
            have += width
        if 2 * width > TRIGGER:
            return mix(out)
        piece = piece[:-width] * power(width) + piece[width:]
        width *= 2


def least_of_runs(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    have = 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if have < width else v


def _content(data: np.ndarray):
    """A function of starts and ends that hashes those bytes."""
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * _powers(_BASE, len(data)), out=total[1:], dtype=U64)
    inverse = _powers(_INVERSE, len(data) + 1)
    return lambda start, end: (total[end] - total[start]) * inverse[start]


def phrases(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, strings, trigger hash, phrase hash) of all phrases; start: place in data of the first of its 50-byte strings."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.view(U64), none.view(U64)
    rolled = _rolled(data)
    width = LENGTH - TRIGGER + 1
    low = least_of_runs((rolled & ~U64((1 << _PLACE) - 1)) | np.arange(len(rolled), dtype=U64), width)
    row = np.repeat(np.arange(len(offsets) - 1), np.maximum(0, np.diff(offsets) - LENGTH + 1))
    first = np.concatenate(([0], np.cumsum(np.maximum(0, np.diff(offsets) - LENGTH + 1))))[:-1]
    place = np.arange(len(row)) - first[row] + offsets[:-1][row]  # every 50-byte string within one document
    if not len(place):
        return none, none, none, none.view(U64), none.view(U64)
    trigger = (low[place] & U64((1 << _PLACE) - 1)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1]))))
    strings = np.diff(np.append(begin, len(place)))
    start, at = place[begin], trigger[begin]
    phrase = mix(_content(data)(start, start + strings + LENGTH - 1) ^ mix(strings * 64 + (at - start)))
    # A trigger's hash needs few bits, as a collision costs one more comparison; what isn't sent needn't be shuffled.
    return row[begin], start, strings, rolled[at] >> U64(16), phrase >> U64(8)


def _merged(row, start, end):
    """Unions of ranges given in order of row and start."""
    if not len(row):
        return row, start, end
    big = np.int64(1) << 40
    reach = np.maximum.accumulate(row * big + end)
    new = np.concatenate(([True], row[1:] * big + start[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return row[first], start[first], reach[np.append(first[1:], len(row)) - 1] - row[first] * big


_KNOWN = ["t", "p", "doc", "at", "len"]
_KNOWN_DDL = "t long, p long, doc long, at long, len int"


def _out(t, p, doc, at, length):
    kinds = (np.int64,) * 4 + (np.int32,)
    arrays = [np.ascontiguousarray(x).view(np.int64) if x.dtype == U64 else x.astype(k) for x, k in zip((t, p, doc, at, length), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=_KNOWN)


def _told_apart(t, p, doc, row, start, end, tag, at):
    """Rows for the shuffle: places to compare, and (len > 0) ranges that an earlier document of this slice covers already."""
    order = np.lexsort((doc, p, t))
    head = np.concatenate(([True], (t[order][1:] != t[order][:-1]) | (p[order][1:] != p[order][:-1])))
    least = np.empty(len(t), np.int64)
    least[order] = doc[order][np.maximum.accumulate(np.where(head, np.arange(len(t)), 0))] if len(t) else doc[order]
    late = doc > least
    yield _out(t[~late], p[~late], doc[~late], at[~late], np.zeros(int((~late).sum()), np.int32))
    if late.any():
        # The ranges are dealt out by a hash of their own.
        r, s, e = _merged(row[late], start[late], end[late])
        of = dict(zip(row[late].tolist(), zip(doc[late].tolist(), tag[late].tolist(), strict=True), strict=True))
        d, g = (np.array([of[x][i] for x in r.tolist()], np.int64) for i in (0, 1))
        yield _out(mix(d.view(U64) + s.astype(U64)), np.zeros(len(r), np.int64), d, s << _TAG | g, e - s)


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """(i, j, bytes of rows i to j, their offsets, place of the first byte in its row): slices of rows, or pieces of one long row that have 49 bytes in common."""
    for i, j in slices(offsets, _SLICE):
        size = offsets[j] - offsets[i]
        if j > i + 1 or size <= _PIECE:
            yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], 0
            continue
        for at in range(0, int(size) - LENGTH + 1, _PIECE):
            part = data[offsets[i] + at : min(offsets[j], offsets[i] + at + _PIECE + LENGTH - 1)]
            yield i, j, part, np.array([0, len(part)]), at


def _ids(column):
    return column.fill_null(_MOST).to_numpy()


def _parse(batches):
    """Rows (t, p, doc, at, len). at: place, (strings - 1) in 6 bits and tag where len is 0, else place and tag."""
    for b in batches:
        data, offsets = text_buffer(b.column("text"))
        ids, tags = _ids(b.column("doc_id")), b.column("tag").to_numpy()
        for i, j, part, o, shift in _pieces(data, offsets):
            row, start, strings, t, p = phrases(part, o)
            tag, s = tags[i:j][row], start - o[row] + shift
            at = s << _AT | (strings - 1) << _TAG | tag
            yield from _told_apart(t, p, ids[i:j][row], row, s, s + strings + LENGTH - 1, tag, at)


def _resolve(batches):
    """From rows in order of (t, p, doc): (doc, tag, start, strings, len): covered ranges have len > 0, phrases to cut up len 0.

    A phrase is cut up where its trigger has another phrase and another document. Held over from batch to batch: what is known of the last
    trigger, and, while it has one phrase or one document only, the places of its phrases' first document; these are places in one document.
    """
    names = ["doc", "tag", "start", "strings", "len"]
    mask = np.int64((1 << _TAG) - 1)

    def out(doc, at, length, ranges):
        start = np.where(ranges, at >> _TAG, at >> _AT)
        strings = np.where(ranges, 0, (at >> _TAG & 63) + 1)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at & mask), pa.array(start), pa.array(strings), pa.array(length.astype(np.int64))], names=names)

    held, waiting = None, []
    for b in batches:
        t, p, doc, at, length = (b.column(x).to_numpy() for x in _KNOWN)
        ready = length > 0
        if ready.any():
            yield out(doc[ready], at[ready], length[ready], np.ones(int(ready.sum()), bool))
            t, p, doc, at = t[~ready], p[~ready], doc[~ready], at[~ready]
        n = len(t)
        if not n:
            continue
        new_t = np.concatenate(([True], t[1:] != t[:-1]))
        new_p = new_t.copy()
        new_p[1:] |= p[1:] != p[:-1]
        starts = np.flatnonzero(new_t)
        ends = np.append(starts[1:], n)
        phrases_, low, high = p[starts] != p[ends - 1], np.minimum.reduceat(doc, starts), np.maximum.reduceat(doc, starts)
        head = np.maximum.accumulate(np.where(new_p, np.arange(n), 0))
        least = doc[head]
        if held is not None and held["t"] == t[0]:
            phrases_[0] |= held["phrases"] or held["p"] != p[0]
            low[0], high[0] = min(low[0], held["low"]), max(high[0], held["high"])
            if held["p"] == p[0]:
                least = np.where(head == 0, held["least"], least)
        else:
            waiting = []
        several = phrases_ & (low < high)
        late = doc > least
        if several[0] and waiting:
            w = np.array(waiting)
            yield out(w[:, 0], w[:, 1], np.zeros(len(w)), np.zeros(len(w), bool))
            waiting = []
        check = ~late & np.repeat(several, ends - starts)
        strings = (at >> _TAG & 63) + 1
        some = late | check
        yield out(doc[some], at[some], np.where(late, strings + LENGTH - 1, 0)[some], np.zeros(int(some.sum()), bool))
        if len(starts) > 1 or several[-1]:
            waiting = []
        if not several[-1]:
            tail = np.flatnonzero(~late[starts[-1] :]) + starts[-1]
            waiting += list(zip(doc[tail].tolist(), at[tail].tolist(), strict=True))
        held = {"t": t[-1], "p": p[-1], "least": least[-1], "phrases": bool(phrases_[-1]), "low": low[-1], "high": high[-1]}


_FOUND_DDL = "doc long, tag long, start long, strings long, len long"


def _cut_up(batches):
    """The 50-byte strings of phrases to compare, as rows for _resolve: t and p are two hashes of the string."""
    for b in batches:
        data, offsets = text_buffer(b.column("text"))
        ids, tags, places = _ids(b.column("doc_id")), b.column("tag").to_numpy(), b.column("places")
        for i, j, part, o, shift in _pieces(data, offsets):
            lists = places.slice(i, j - i)
            row = np.repeat(np.arange(j - i), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            start, strings = (flat.field(x).to_numpy() for x in ("start", "strings"))
            start = start - shift
            mine = (start >= 0) & (start < _PIECE) if len(o) == 2 else np.ones(len(row), bool)
            order = np.lexsort((start[mine], row[mine]))
            row, start, strings = (x[mine][order] for x in (row, start, strings))
            each = np.repeat(np.arange(len(row)), strings)
            s = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(strings) - strings, strings)
            row = row[each]
            at = s + o[row]
            h = _content(part)(at, at + LENGTH)
            again = _content(part[::-1])(len(part) - at - LENGTH, len(part) - at)  # the same string backwards
            tag, s = tags[i:j][row], s + shift
            yield from _told_apart(mix(h) >> U64(16), mix(again ^ U64(0x7375)) >> U64(8), ids[i:j][row], row, s, s + LENGTH, tag, s << _AT | tag)


def _assemble(batches):
    for b in batches:
        texts, ids, ranges = b.column("text"), b.column("doc_id"), b.column("ranges").to_pylist()
        n_bytes, removed, spans, digest = [], [], [], []
        for text, found in zip(texts.to_pylist(), ranges, strict=True):
            raw = (text or "").encode()
            kept, at, gone, count, last = hashlib.sha256(), 0, 0, 0, -1
            for s, e in sorted((x["start"], x["start"] + x["len"]) for x in found or ()):
                if s > last:
                    kept.update(raw[at:s])
                    count += 1
                    at = s
                if e > at:
                    gone += e - at
                    at = e
                last = max(last, e)
            kept.update(raw[at:])
            n_bytes.append(len(raw))
            removed.append(gone)
            spans.append(count)
            digest.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (n_bytes, removed, spans)), pa.array(digest)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _numbered(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) with doc, what stands for the id, tag, which differs for different texts of one id, and again, whether the id repeats.

    Only ids that repeat are looked at; their texts are ranked by hash within parts, so an id that very many rows have is no single task's work.
    """
    named = docs.withColumn("doc", F.coalesce("doc_id", F.lit(_MOST)))
    often = save(named.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc"), f"{path}/repeated")
    zero = F.lit(0).cast("long")
    if often.isEmpty():
        return named.withColumn("tag", zero).withColumn("again", F.lit(False))
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    texts = named.join(often, "doc", "left_semi").select("doc", sha.alias("sha")).distinct().withColumn("part", F.substring("sha", 1, 3))
    texts = save(texts.withColumn("at", F.row_number().over(Window.partitionBy("doc", "part").orderBy("sha"))), f"{path}/texts")
    parts = texts.groupBy("doc", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("doc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("doc", "part", F.coalesce(before, F.lit(0)).alias("before"))
    tags = save(texts.join(parts, ["doc", "part"]).select("doc", "sha", (F.col("at") + F.col("before") - 1).cast("long").alias("tag")), f"{path}/tags")
    if (tags.agg(F.max("tag")).first()[0] or 0) >> _TAG:
        raise ValueError(f"more than {1 << _TAG} different texts share one doc_id")
    # An id without a tag doesn't repeat.
    return named.withColumn("sha", sha).join(tags, ["doc", "sha"], "left").select("doc_id", "text", "doc", F.coalesce("tag", zero).alias("tag"), F.col("tag").isNotNull().alias("again"))


def covered_ranges(docs: DataFrame, path: str) -> DataFrame:
    """(doc, tag, start, len): byte ranges of docs (doc_id, text, doc, tag) that earlier documents cover; they may overlap."""
    order = lambda df: df.repartition("t").sortWithinPartitions("t", "p", "doc").mapInArrow(_resolve, _FOUND_DDL)
    found = save(order(docs.select("doc_id", "text", "tag").mapInArrow(_parse, _KNOWN_DDL)), f"{path}/phrases")
    # Places of one text in each list.
    places = found.where("len = 0").groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "strings")).alias("places"))
    # Rows of one id and text have the same places; one of them stands for all.
    met = docs.join(places, ["doc", "tag"])
    strings = met.where(~F.col("again")).unionAll(met.where("again").dropDuplicates(["doc", "tag"])).select("doc_id", "text", "tag", "places").mapInArrow(_cut_up, _KNOWN_DDL)
    more = save(order(strings), f"{path}/strings")
    return found.where("len > 0").select("doc", "tag", "start", "len").union(more.where("len > 0").select("doc", "tag", "start", "len"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs (doc_id, text)."""
    path = work_dir(docs.sparkSession, "substrings")
    docs = _numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path)
    ranges = covered_ranges(docs, path).groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "len")).alias("ranges"))
    return docs.join(ranges, ["doc", "tag"], "left").select("doc_id", "text", "ranges").mapInArrow(_assemble, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
