"""Vector codes, resampling, MinHash and row identity against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import contamination, minhash, mixture, quality, resampling, shared, substrings, toxicity, vector_codes

DOCS = "doc_id long, text string"


def slow_codes(x: np.ndarray, parts: int, k: int, rounds: int):
    books = x[:k].reshape(-1, parts, x.shape[1] // parts).transpose(1, 0, 2).copy()
    own = x.reshape(len(x), parts, -1)
    near = lambda: ((own[:, :, None] - books[None]) ** 2).sum(3)
    for _ in range(rounds):
        code = near().argmin(2)
        for p in range(parts):
            for e in range(books.shape[1]):
                if (mine := own[code[:, p] == e, p]).size:
                    books[p, e] = mine.sum(0) // len(mine)
    d = near()
    return d.argmin(2), d.min(2).sum(1), books


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_filtering_equals_full_comparison(spark, spread, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 100)
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(size=(250, 16)) * spread, np.zeros((40, 16)), np.round(rng.normal(size=(100, 16)))])
    rows = [(i if i % 50 else None, r.tolist(), None if i % 3 == 0 else i % 4) for i, r in enumerate(v)] + [(1, v[1].tolist(), 1)] * 3
    odd = [(1000, None, 1), (1001, [], 1), (1002, [float("nan")] * 16, 1), (1003, [float("inf")] * 16, 1), (1004, [None] * 16, 1), (1005, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("mine"))
    coded, books = vector_codes.encode_vectors(df)
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    codes, errors, want = slow_codes(vector_codes.whole_numbers(np.array([r[1] for r in ordered])), 8, 16, 6)
    assert (books == want).all()
    got = vector_codes.with_label_errors(coded).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in got), key=key) == sorted(((r[0], "".join(f"{c:02x}" for c in code), int(e)) for r, code, e in zip(ordered, codes, errors, strict=True)), key=key)
    by_label = Counter()
    for r, e in zip(ordered, errors, strict=True):
        by_label[r[2]] += int(e)
    assert {(r["label"], r["label_error"]) for r in got} == set(by_label.items())


def test_trees_save_comparisons_and_edges(spark):
    x = vector_codes.whole_numbers(np.concatenate([np.random.default_rng(1).normal(c, 0.01, (500, 4)) for c in range(4)]))
    tree = vector_codes.Tree(x)
    again = vector_codes.Tree.restored(x, *tree.numbers())
    sums, counts, looked = again.assigned(x[::500].copy())
    assert counts.tolist() == [500] * 4 and (sums == x.reshape(4, 500, 4).sum(1)).all() and looked < len(x)
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>, label string")
    assert vector_codes.encode_vectors(empty)[0].count() == 0
    few, books = vector_codes.encode_vectors(spark.createDataFrame([(1, [1.0] * 8, "a"), (2, [2.0] * 8, "a")], "vec_id long, embedding array<double>, label string"))
    assert sorted(r["code"] for r in few.collect()) == ["00" * 8, "01" * 8] and books.shape == (8, 2, 1)
    with pytest.raises(ValueError):
        vector_codes.encode_vectors(spark.createDataFrame([(1, [1.0] * 9, 1)], "vec_id long, embedding array<double>, label int"))


def slow_resample(docs, target, most, buckets, least, percent):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda t: [" ".join(w[i : i + k]) for w in [words(t)] for k in range(1, most + 1) for i in range(len(w) - k + 1)]
    at = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(at(g) for _, x in docs for g in grams(x)), Counter(at(g) for x in target for g in grams(x))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets))))
    out = []
    for i, x in docs:
        f = grams(x)
        w = sum(gain(at(g)) for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(x)) >= least))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(((*r[:4], drawn.get(id(r))) for r in out), key=str)


@pytest.mark.parametrize("most", [1, 2])
def test_resampling(spark, most, monkeypatch):
    monkeypatch.setattr(resampling, "_PIECE", 200)
    rng = np.random.default_rng(2)
    vocab = ["alpha", "Beta", "ÉCOLE", "école", "x1", "7", "日本", "don't"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", "\n", ", ", "\x00"]) for _ in range(n))
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(60)] + [(None, text(30)), (None, None), (5, docs5 := text(25)), (5, docs5), (70, ""), (71, "..,"), (72, text(900))]
    df = spark.createDataFrame(docs, DOCS).withColumn("row", F.lit("mine")).withColumn("weight", F.lit(1))
    target = [text(40), None, "alpha beta " * 9]
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), most=most, buckets=50, percent=40)
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_resample(docs, target, most, 50, 20, 40)
    nothing = spark.createDataFrame([], DOCS)
    assert resampling.resample(nothing, nothing, most=most).count() == 0
    assert resampling.resample(df, nothing, most=most).count() == len(docs)


def slow_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return sets, root


def test_minhash_components(spark):
    rng = np.random.default_rng(3)
    texts = [None, "", " \n", "One", "one", "two words", "Two Words", "two  words!"]
    for _ in range(6):
        base = [f"w{k}" for k in rng.integers(0, 400, 60)]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4, 5, 6, 7):
            for _ in range(3):
                own = list(base)
                for k in rng.integers(0, 60, edits):
                    own[k] = f"e{rng.integers(0, 30)}"
                texts.append(" ".join(own))
    ring = [f"r{k}" for k in range(200)]  # neighbours link, others don't
    texts += [" ".join(ring[k : k + 60]) for k in range(0, 140, 5)]
    docs = [(1000 - i, t) for i, t in enumerate(texts)] + [(None, "alone in here"), (None, texts[8]), (1000, "one")]
    sets, root = slow_components([t for _, t in docs])
    least = {}
    for (i, _), r in zip(docs, root, strict=True):
        least[r] = min(x for x in (least.get(r), i) if x is not None) if (least.get(r), i) != (None, None) else None
    want = sorted(((i, len(s), least[r] if s else i, (i == least[r]) if s else True) for (i, _), s, r in zip(docs, sets, root, strict=True)), key=str)
    got = minhash.near_duplicates(spark.createDataFrame(docs, DOCS).withColumn("key", F.lit(0)).withColumn("n", F.lit(0)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_stars(spark, tmp_path):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(64)] + [(5000, 6000 + i) for i in range(50)] + [(7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["id"]: r["root"] for r in minhash.stars(spark.createDataFrame(edges, "a long, b long"), str(tmp_path)).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert minhash.stars(spark.createDataFrame([], "a long, b long"), str(tmp_path / "none")).count() == 0


def test_mix_stage_takes_what_the_plan_says(spark):
    rows = [(None, "a " * (1 + i % 25), s) for s in ("A", "B", None) for i in range(350)] + [(7, "b b b", "A")] * 5 + [(8, None, "A"), (9, "", "B")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = df.withColumn("size", F.lit("mine")).withColumn("copies", F.lit(0)).withColumn("place", F.lit(1))
    plan = mixture.mix_sources(df).groupBy("source", "size").agg(F.sum("copies").alias("n")).where("n > 0")
    words = F.size(F.split(F.trim("text"), " ")).cast("long")
    got = mixture.mix_stage(df)
    assert got.columns == df.columns
    taken = got.groupBy("source", words.alias("size")).agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, taken.collect()), key=str) == sorted(map(tuple, plan.collect()), key=str)


def test_bounded_samples(spark):
    df = spark.createDataFrame([(1, f"t{i % 40}") for i in range(400)] + [(None, None)] * 50, DOCS)
    for most in (10, 1000):
        got = shared.bounded_sample(df, most, ["doc_id", "text"]).collect()
        assert len(got) == len({tuple(r) for r in got}) == min(most, 41)
    docs = spark.createDataFrame([(1, f"good text number {i}") for i in range(300)] + [(2, "bad !!!! ####")] * 30, DOCS)
    labels = spark.createDataFrame([(1, 1)] * 300 + [(2, 0)] * 50, "doc_id long, quality int")
    model = quality.train(docs, labels, most=100)
    assert len(model["w"]) and quality.score_documents(docs, model).count() == 330
    scored = toxicity.score_documents(docs, toxicity.train(docs, labels.withColumnRenamed("quality", "toxic")))
    assert scored.count() == 330


def test_strings_of_repeated_rows_are_cut_up_once(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = "".join(chr(97 + k) for k in rng.integers(0, 26, 400))
    texts = [(1, base), (2, base[:150] + "Q" + base[151:]), (3, base[40:300] + "Z" + base[100:])]
    made = []
    for repeats in (1, 60):
        docs = spark.createDataFrame(texts + [(None, base[20:220] + "XY" + base[230:])] * repeats, DOCS)
        numbered = substrings._numbered(docs, str(tmp_path / f"n{repeats}"))
        substrings.covered_ranges(numbered, str(tmp_path / f"r{repeats}"))
        made.append(spark.read.parquet(str(tmp_path / f"r{repeats}" / "strings")).count())
    assert made[1] <= made[0] + 2


def test_clean_with_clashing_columns(spark):
    item = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, item), (2, "clean text"), (None, None)], DOCS).withColumn("_sha", F.lit(1)).withColumn("sha", F.lit(2))
    bench = spark.createDataFrame([(1, item), (None, None)], "item_id long, text string")
    for most in (0, 1000):
        assert sorted((r["doc_id"] for r in contamination.clean(docs, bench, most).collect()), key=str) == [2, None]
