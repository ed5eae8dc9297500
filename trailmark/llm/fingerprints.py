"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last 7 bytes ends a chunk wherever it is -1 modulo the block size
3 * 2^k. Each chunk gives one letter. The block size is the least whose signature has at most
64 letters (runs of one letter are cut to three), and a fingerprint is
"block:signature:signature at twice the block". Two fingerprints compare where their block
sizes are equal or one is twice the other: likeness = 1 - edit distance / longer length.

Defined cases: a null text counts as empty, its fingerprint is "3::"; equal texts have equal
fingerprints and likeness 1; a lone document is its own next document; rows that repeat a
doc_id follow one another in order of their text; a null doc_id sorts first. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, save, work_dir

WINDOW, LETTERS = 7, 64
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_CODE = np.zeros(256, np.uint8)
_CODE[ALPHABET] = np.arange(64)
_FACTORS = [np.uint32(pow(0x01000193, j + 1, 1 << 32)) for j in range(WINDOW)]


def _letters(mass: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One letter for each chunk; ends: position after each trigger. A rest is a chunk as well."""
    starts = np.concatenate(([0], ends)) if not len(ends) or ends[-1] < len(mass) else np.concatenate(([0], ends[:-1]))
    h = np.add.reduceat(mass, starts, dtype=np.uint32) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    letters = (h * np.uint32(0x85EBCA77)) >> np.uint32(26)
    if len(letters) > 3:
        same = letters[1:] == letters[:-1]
        run = np.zeros(len(letters), bool)
        run[3:] = same[2:] & same[1:-1] & same[:-2]
        letters = letters[~run]
    return letters


def fingerprint(text: bytes) -> str:
    n = len(text)
    if not n:
        return "3::"
    padded = np.zeros(n + WINDOW - 1, np.uint32)
    padded[WINDOW - 1 :] = np.frombuffer(text, np.uint8)
    roll = padded[WINDOW - 1 :] * _FACTORS[0]
    for j in range(1, WINDOW):
        roll = roll + padded[WINDOW - 1 - j : WINDOW - 1 - j + n] * _FACTORS[j]
    roll ^= roll >> np.uint32(15)
    roll *= np.uint32(0x2C1B3C6D)
    roll ^= roll >> np.uint32(13)
    up = roll + np.uint32(1)
    at = np.flatnonzero(up % np.uint32(3) == 0)
    hit = up[at]
    low = hit & (~hit + np.uint32(1))  # the lowest set bit
    mass = roll | np.uint32(1)
    k = 0
    while np.count_nonzero(low >= np.uint32(1 << k)) >= LETTERS:
        k += 1
    ends = lambda k: at[(low >= np.uint32(1 << k)) | (low == 0)] + 1 if k < 32 else at[:0]
    first = _letters(mass, ends(k))
    while k and len(finer := _letters(mass, ends(k - 1))) <= LETTERS:
        first, k = finer, k - 1
    second = _letters(mass, ends(k + 1))
    return f"{3 << k}:{ALPHABET[first].tobytes().decode()}:{ALPHABET[second].tobytes().decode()}"


def edit_distances(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Levenshtein distances of many pairs of at most 64 letters each, bit-parallel over all pairs."""
    n = len(left)
    m, length = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    one = np.uint64(1)
    codes = np.zeros((n, LETTERS), np.uint8)
    other = np.zeros((n, LETTERS), np.uint8)
    for to, given in ((codes, left), (other, right)):
        flat = np.frombuffer(b"".join(x.ljust(LETTERS, b"A") for x in given), np.uint8).reshape(n, LETTERS)
        to[:] = _CODE[flat]
    rows = np.arange(n)
    masks = np.zeros((n, LETTERS), np.uint64)
    for i in range(int(m.max(initial=0))):
        use = np.flatnonzero(m > i)
        masks[use, codes[use, i]] |= one << np.uint64(i)
    top = np.where(m > 0, m - 1, 0).astype(np.uint64)
    vp, vn, score = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64), m.copy()
    for j in range(int(length.max(initial=0))):
        eq = masks[rows, other[:, j]]
        x = eq | vn
        d0 = (((x & vp) + vp) ^ vp) | x
        hn, hp = vp & d0, vn | ~(vp | d0)
        on = length > j
        score += np.where(on, ((hp >> top) & one).astype(np.int64) - ((hn >> top) & one).astype(np.int64), 0)
        hp, hn = (hp << one) | one, hn << one
        vp, vn = hn | ~(d0 | hp), hp & d0
    return np.where(m == 0, length, score)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints."""
    out = np.zeros(len(left))
    at, a, b = [], [], []
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        if x == y:
            out[i] = 1.0
            continue
        (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
        bx, by = int(bx), int(by)
        pair = (x1, y1) if bx == by else (x2, y1) if by == 2 * bx else (x1, y2) if bx == 2 * by else None
        if pair and pair[0] and pair[1]:
            at.append(i)
            a.append(pair[0].encode())
            b.append(pair[1].encode())
    for i in range(0, len(at), 4096):
        d = edit_distances(a[i : i + 4096], b[i : i + 4096])
        most = np.maximum([len(x) for x in a[i : i + 4096]], [len(x) for x in b[i : i + 4096]])
        out[at[i : i + 4096]] = 1 - d / most
    return out


def edited(text: str, following: str) -> str:
    """The last quarter of text replaced by as many first code points of the following text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(items: list[tuple], following: list[tuple[str, str]]) -> dict:
    """items: (doc_id, text, fingerprint); following: (text, fingerprint) of the next document."""
    changed = [edited(x[1], y[0]).encode() for x, y in zip(items, following, strict=True)]
    prints = [x[2] for x in items]
    other = [x[2] if c == x[1].encode() else fingerprint(c) for x, c in zip(items, changed, strict=True)]
    return {
        "doc_id": [x[0] for x in items],
        "n_chars": [len(x[1]) for x in items],
        "edited_sha256": [hashlib.sha256(c).hexdigest() for c in changed],
        "fingerprint": prints,
        "edited_fingerprint": other,
        "near_edited": likeness(prints, other),
        "near_next": likeness(prints, [y[1] for y in following]),
    }


def _compare_sorted(batches):
    """Over documents in order. A partition's first text goes along, and its last document waits for the next partition's first."""
    part = TaskContext.get().partitionId()
    types = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(), "part": pa.int32(), "first_text": pa.string(), "last_text": pa.string()}
    schema = pa.schema(list(types.items()))

    def out(items, following, first=None, last=None):
        rows = _rows(items, following) if last is None else dict.fromkeys(list(types)[:7], [None]) | {"doc_id": [items[0][0]], "n_chars": [len(items[0][1])], "fingerprint": [items[0][2]]}
        n = len(items)
        return pa.RecordBatch.from_pydict(rows | {"part": [part] * n, "first_text": [first] + [None] * (n - 1), "last_text": [last] * n}, schema=schema)

    held, opening = None, None
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i in range(0, batch.num_rows, 1000):
            t = [x or "" for x in texts.slice(i, 1000).to_pylist()]
            items = list(zip(ids.slice(i, 1000).to_pylist(), t, [fingerprint(x.encode()) for x in t], strict=True))
            opening = items[0][1] if held is None else opening
            items = [held, *items] if held is not None else items
            if len(items) > 1:
                yield out(items[:-1], [x[1:] for x in items[1:]], opening)
                opening = None
            held = items[-1]
    if held is not None:
        yield out([held], None, opening, held[1])


def _compare_pairs(batches):
    for batch in batches:
        ids, texts, after = (batch.column(i).to_pylist() for i in range(3))
        after = [x or "" for x in after]
        items = [(i, t or "", fingerprint((t or "").encode())) for i, t in zip(ids, texts, strict=True)]
        yield pa.RecordBatch.from_pydict(_rows(items, [(x, fingerprint(x.encode())) for x in after]))


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text, of its edited text, and their likeness; see the module for the cases.

    Texts are shuffled once, by ranges of doc_id. Only the last document of each partition
    needs the first of the next one: those pairs, one for a partition, are joined afterwards.
    """
    spark = docs.sparkSession
    at = work_dir(spark, "fingerprints")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = save(rows.mapInArrow(_compare_sorted, f"{_OUT}, part int, first_text string, last_text string"), at)
    firsts = rows.where("first_text is not null").select("part", "first_text")
    lasts = rows.where("last_text is not null").select("part", "doc_id", "last_text")
    # One row for a partition: its number and that of the next one with rows.
    ring = firsts.select("part").withColumn("next", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())))
    pairs = lasts.join(ring, "part").join(firsts.select(F.col("part").alias("next"), "first_text"), "next")
    fixed = pairs.select("doc_id", "last_text", "first_text").mapInArrow(_compare_pairs, _OUT)
    names = [x.split()[0] for x in _OUT.split(", ")]
    return rows.where("last_text is null").select(*names).unionByName(fixed)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(documents(spark, sf_dir))
