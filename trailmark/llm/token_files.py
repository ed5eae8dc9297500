"""Token ids in binary shards, with a minimal perfect hash index from document key to shard offset.

Files, all little-endian:

* ids/shard-NNNNNN.ids: 16 bytes ("TMIDS001", item size, 0 as two uint32), then the ids of the
  shard's documents, uint16 where the vocabulary has at most 65536 ids, else uint32. Shards follow ranges of
  doc_id, so reading them in order gives ascending doc_id.
* index/bucket-NNNNNN.mph: the keys whose mixed 64 bits fall into that bucket. 32 bytes of header ("TMMPH001",
  keys, levels, overflow, 0 as uint64/uint32s), the bit count of each level (uint64), the levels' bits, a running count of set bits
  for each 64-bit word (uint32), and for each slot: fingerprint and shard (uint32), offset and length (uint64).
  A key is looked up with one bit probe a level (1.6 on average), one rank and one slot, whatever the number of keys; the
  fingerprint rejects most keys that were never indexed.

The perfect hash: each level has twice as many bits as keys left; keys alone on their bit are done, the others go
on to the next level. A bucket is built by one task from about `keys_per_bucket` keys, so no task grows with the corpus.

Defined cases: a null text is an empty one and has the end id alone; a repeated doc_id gives keys (doc_id, 0), (doc_id, 1), ...
in order of text; a null doc_id sorts first and has a key of its own; an empty table writes no file. A file is written under another name
and renamed, so a task that runs again replaces it whole.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import U64, documents, mix, save, work_dir

END_ID = 2
KEYS_PER_BUCKET = 8192
SHARD_MAGIC, INDEX_MAGIC = b"TMIDS001", b"TMMPH001"
_MOST_LEVELS = 40


# ---- encoding ---------------------------------------------------------------------------------

#: Texts of these characters alone can be cut into pieces here; others go through the library whole.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+")
#: The same pieces of a lower-cased text without an apostrophe, found faster.
_BARE_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[^\sa-z0-9ß-öø-ÿ]+|\d")
_KEPT_PIECES = 300_000


class Encoder:
    """Ids of whole texts, exactly the library's, with an encoding kept for each piece.

    In a vocabulary with word ends a piece's ids don't depend on its neighbours. Only where the tokenizer file has the normalizer and
    the split that the pieces here follow, and a text has plain characters only, are pieces used.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        split = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
        same = [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        same = same and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["pattern"].get("Regex") == split
        self.kind = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.pieces: dict[str, bytes] | None = None
        if same and spec["model"]["type"] == "BPE" and spec["model"].get("end_of_word_suffix"):
            self.part = Tokenizer.from_file(path)
            self.part.normalizer = normalizers.Sequence([])
            self.part.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            gap = self.part.encode("\x01", add_special_tokens=False).ids  # never part of a plain text
            if len(gap) == 1:
                self.gap, self.pieces = gap[0], {}

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        found, size = {}, self.kind.itemsize
        for i in range(0, len(new), 64):
            some = new[i : i + 64]
            ids = np.array(self.part.encode_batch_fast([" \x01 ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.flatnonzero(ids == self.gap)
            raw = ids.tobytes()
            ends = [*(cuts * size).tolist(), len(raw)]
            starts = [0, *((cuts + 1) * size).tolist()]
            found |= {w: raw[a:b] for w, a, b in zip(some, starts, ends, strict=True)}
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        if self.pieces is not None:
            cut = {i: (_PIECE if "'" in t else _BARE_PIECE).findall(t.lower()) for i, t in enumerate(texts) if _PLAIN.fullmatch(t) and "<|" not in t}
            new = list(set().union(*cut.values()) - self.pieces.keys())
            known = self.pieces
            if len(known) + len(new) > _KEPT_PIECES:
                known = self.pieces = {w: known[w] for x in cut.values() for w in x if w in known}
            known |= self._learn(new)
            for i, x in cut.items():
                out[i] = b"".join(map(known.__getitem__, x))
        rest = [i for i, x in enumerate(out) if x is None]
        for i in range(0, len(rest), 64):
            some = rest[i : i + 64]
            for j, e in zip(some, self.whole.encode_batch_fast([texts[j] for j in some], add_special_tokens=False), strict=True):
                out[j] = np.array(e.ids, self.kind).tobytes()
        return out


# ---- files ------------------------------------------------------------------------------------


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if re.match(r"\w+:", uri) else (pafs.LocalFileSystem(), uri)


def _put(folder: str, name: str, chunks) -> None:
    """Write chunks to folder/name by way of another name."""
    fs, at = _store(folder)
    fs.create_dir(at, recursive=True)
    c = TaskContext.get()
    draft = f"{at}/.{name}-{c.taskAttemptId() if c else 0}"
    with fs.open_output_stream(draft) as f:
        for x in chunks:
            f.write(x)
    fs.move(draft, f"{at}/{name}")


def _shard_writer(folder: str, path: str, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("shard", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])

    def write(batches):
        part, encoder = TaskContext.get().partitionId(), None
        ids, lengths = [], []

        def chunks():
            nonlocal encoder
            for batch in batches:
                if encoder is None:
                    encoder = Encoder(path)
                    yield SHARD_MAGIC + struct.pack("<II", encoder.kind.itemsize, 0)
                end = np.array([end_id], encoder.kind).tobytes()
                for i in range(0, batch.num_rows, 500):
                    ids.extend(batch.column(0).slice(i, 500).to_pylist())
                    for raw in encoder.encode([t or "" for t in batch.column(1).slice(i, 500).to_pylist()]):
                        lengths.append((len(raw) + len(end)) // encoder.kind.itemsize)
                        yield raw + end

        stream = chunks()
        first = next(stream, None)
        if first is None:
            return
        _put(f"{folder}/ids", f"shard-{part:06d}.ids", (x for part_ in ((first,), stream) for x in part_))
        copy = [0] * len(ids)
        for i in range(1, len(ids)):
            copy[i] = copy[i - 1] + 1 if ids[i] == ids[i - 1] else 0
        length = np.array(lengths, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(copy, pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array(np.cumsum(length) - length), pa.array(length)], schema=schema)

    return write


def _keys(doc_id: pa.Array, copy: np.ndarray) -> np.ndarray:
    known = np.array(doc_id.is_valid())
    k = mix(doc_id.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64))
    k = np.where(known, k, mix(k ^ U64(0x6E756C6C)))
    copy = copy.astype(U64)
    return np.where(copy == 0, k, mix(k + copy * U64(0x9E3779B97F4A7C15)))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)


def _spot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return mix(keys + U64(level + 1)) % U64(max(1, bits))


def build_index(keys: np.ndarray, shard: np.ndarray, offset: np.ndarray, length: np.ndarray) -> bytes:
    """One bucket's index file."""
    left, levels, sizes = keys, [], []
    while len(left) and len(levels) < _MOST_LEVELS:
        bits = -(-2 * len(left) // 64) * 64
        at = _spot(left, len(levels), bits)
        count = np.bincount(at.astype(np.int64), minlength=bits)
        levels.append(count == 1)
        sizes.append(bits)
        left = left[count[at.astype(np.int64)] > 1]
    if len(left):
        raise ValueError(f"{len(left)} keys share all their hash values")
    flat = np.concatenate(levels) if levels else np.zeros(0, bool)
    words = np.packbits(flat, bitorder="little").view("<u8") if len(flat) else np.zeros(0, "<u8")
    per_word = np.bitwise_count(words).astype(np.int64)
    ranks = (np.cumsum(per_word) - per_word).astype("<u4")
    head = INDEX_MAGIC + struct.pack("<QIIQ", len(keys), len(sizes), 0, 0)
    index = Index(head + np.array(sizes, "<u8").tobytes() + words.tobytes() + ranks.tobytes() + bytes(24 * len(keys)))
    slots = np.zeros(len(keys), _SLOT)
    at = index.slot(keys)
    slots["print"][at], slots["shard"][at], slots["offset"][at], slots["length"][at] = mix(keys ^ U64(0xF1)) >> U64(32), shard, offset, length
    return index.raw[: index.slots_at] + slots.tobytes()


_SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("length", "<u8")])


class Index:
    def __init__(self, raw: bytes):
        if raw[:8] != INDEX_MAGIC:
            raise ValueError("not an index file")
        n, levels, _, _ = struct.unpack_from("<QIIQ", raw, 8)
        self.raw, self.n = raw, n
        self.sizes = np.frombuffer(raw, "<u8", levels, 32)
        words = int(self.sizes.sum()) // 64
        at = 32 + 8 * levels
        self.words = np.frombuffer(raw, "<u8", words, at)
        self.ranks = np.frombuffer(raw, "<u4", words, at + 8 * words)
        self.slots_at = at + 12 * words
        self.slots = np.frombuffer(raw, _SLOT, n, self.slots_at)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; of others any slot, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, bits in enumerate(self.sizes.tolist()):
            at = _spot(keys[left], level, bits).astype(np.int64) + base
            word, bit = at >> 6, (at & 63).astype(U64)
            value = self.words[word]
            on = (value >> bit) & U64(1) == 1
            out[left[on]] = self.ranks[word[on]] + np.bitwise_count(value[on] & ((U64(1) << bit[on]) - U64(1)))
            left, base = left[~on], base + bits
            if not len(left):
                break
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key whose fingerprint is there, else -1."""
        at = self.slot(keys)
        ok = at >= 0
        ok[ok] = self.slots["print"][at[ok]] == mix(keys[ok] ^ U64(0xF1)) >> U64(32)
        return np.where(ok, at, -1)


def _index_writer(folder: str):
    def write(key, table):
        k = _keys(table.column("doc_id").combine_chunks(), table.column("copy").to_numpy())
        raw = build_index(k, *(table.column(x).to_numpy() for x in ("shard", "offset", "length")))
        bucket = key[0].as_py()
        _put(f"{folder}/index", f"bucket-{bucket:06d}.mph", [raw])
        return pa.table({"bucket": [bucket], "keys": [len(k)]}, schema=pa.schema([("bucket", pa.int64()), ("keys", pa.int64())]))

    return write


def _bucket_of(buckets: int):
    def add(batches):
        for b in batches:
            k = _bucket(_keys(b.column("doc_id"), b.column("copy").to_numpy()), buckets)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k, pa.int64())], names=[*b.schema.names, "bucket"])

    return add


_PLACES = "doc_id long, copy long, shard int, offset long, length long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, keys_per_bucket: int = KEYS_PER_BUCKET) -> dict:
    """Write shards and index below folder; returns {"folder", "buckets", "places"}, places a table of what was written."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    places = save(rows.mapInArrow(_shard_writer(folder, tokenizer, end_id), _PLACES), f"{folder}/places")
    buckets = max(1, -(-places.count() // keys_per_bucket))
    keyed = places.mapInArrow(_bucket_of(buckets), f"{_PLACES}, bucket long")
    keyed.groupBy("bucket").applyInArrow(_index_writer(folder), "bucket long, keys long").write.mode("overwrite").parquet(f"{folder}/buckets")
    return {"folder": folder, "buckets": buckets, "places": places}


def _finder(folder: str):
    def find(key, table):
        keys = _keys(table.column("doc_id").combine_chunks(), table.column("copy").to_numpy())
        fs, at = _store(f"{folder}/index/bucket-{key[0].as_py():06d}.mph")
        place = np.full(len(keys), -1)
        if fs.get_file_info(at).type == pafs.FileType.File:
            with fs.open_input_file(at) as f:
                index = Index(f.read())
            place = index.find(keys)
        known = place >= 0
        slots = index.slots[place[known]] if known.any() else np.zeros(0, _SLOT)
        table = table.select(["doc_id", "copy"]).filter(pa.array(known))
        for name, kind in (("shard", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())):
            table = table.append_column(name, pa.array(slots[name].astype(np.int64), pa.int64()).cast(kind))
        return table

    return find


def lookup(keys: DataFrame, files: dict) -> DataFrame:
    """Places (doc_id, copy, shard, offset, length) of the keys (doc_id, copy), by the index alone. Unknown keys have no row."""
    keyed = keys.select("doc_id", "copy").mapInArrow(_bucket_of(files["buckets"]), "doc_id long, copy long, bucket long")
    return keyed.groupBy("bucket").applyInArrow(_finder(files["folder"]), _PLACES)


def _reader(folder: str):
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("shard", pa.int32()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        shard, file, kind = -1, None, None
        for b in batches:
            sums = []
            for s, o, n in zip(*(b.column(x).to_pylist() for x in ("shard", "offset", "length")), strict=True):
                if s != shard:
                    if file:
                        file.close()
                    fs, at = _store(f"{folder}/ids/shard-{s:06d}.ids")
                    file, shard = fs.open_input_file(at), s
                    head = file.read(16)
                    if head[:8] != SHARD_MAGIC:
                        raise ValueError(f"{at} is no shard")
                    kind = np.dtype(f"<u{struct.unpack_from('<I', head, 8)[0]}")
                file.seek(16 + o * kind.itemsize)
                raw = file.read(n * kind.itemsize)
                if len(raw) != n * kind.itemsize:
                    raise ValueError(f"shard {s} ends early")
                sums.append(zlib.crc32(np.frombuffer(raw, kind).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("copy"), b.column("shard"), b.column("offset"), b.column("length"), pa.array(sums, pa.int64())], schema=schema)
        if file:
            file.close()

    return read


def read_digests(keys: DataFrame, files: dict) -> DataFrame:
    """Read the ids of the keys back by way of the index: doc_id, copy, start, n_tokens, ids_crc32."""
    found = lookup(keys, files).repartition("shard").sortWithinPartitions("shard", "offset")
    rows = found.mapInArrow(_reader(files["folder"]), "doc_id long, copy long, shard int, offset long, n_tokens long, ids_crc32 long")
    # One row for a shard.
    totals = files["places"].groupBy("shard").agg(F.sum("length").alias("n"))
    before = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before) if before.count() <= 100_000 else before, "shard").select("doc_id", "copy", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write all documents' ids, then read every document back through the index."""
    files = write_tokens(docs, work_dir(docs.sparkSession, "tokens"), tokenizer or public_tokenizer())
    return read_digests(files["places"].select("doc_id", "copy"), files)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(documents(spark, sf_dir)).select("doc_id", "start", "n_tokens", "ids_crc32")
