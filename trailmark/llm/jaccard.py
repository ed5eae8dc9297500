"""Exact n-gram Jaccard join with a token-group matrix.

A document's set holds the hashes of its distinct 5-word shingles. Documents with equal sets form a class
and are linked without comparison; everything below is on classes, keyed by a 64-bit hash of the set.

1. Pruning. A class of n shingles shares at least ceil(0.8 n) of them with any partner, so one with more than
   n - ceil(0.8 n) shingles that no other class has is alone. A fixed share of all shingles (by hash) is counted for that, in
   one shuffle; most documents end here.
2. Groups. The classes left are put into groups of similar ones: each class is compared with the first one of its bucket under
   each of a few min-hashes, and what links is joined. So thousands of near copies cost a few comparisons each and no pairs among them.
3. Token-group matrix. It has a row (token, group) for each shingle of a group's union. The overlap of a class with all
   other groups together bounds its overlap with each: classes that share less than ceil(0.8 n) of their shingles with other groups are done.
   For the others, only groups that have a token of the class's rarest-first prefix are candidates, the
   overlap with each candidate's union is counted in the matrix, and only groups that reach ceil(0.8 n) are opened: their
   members of fitting size with a common prefix token, early enough for the overlap asked, are compared exactly.

Links found in 2 and 3 contain a spanning forest of all links, which gives the components; no link between groups is lost.
Shingles are compared as 64-bit hashes: with 10^10 distinct ones, about 3 pairs of them collide.

Defined cases: null, empty and white-space texts have no shingle and are linked with nothing; fewer than five words are
one shingle; repeated rows are linked; a null doc_id keeps its row (its component is the least id linked to it, or null); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import U64, Words, components, distinct_sets, documents, fresh, mix, save, sieve, slices, text_buffer, work_dir

#: Share of all shingles, by hash, that pruning counts; over a fifth, which is what a class may have for itself.
SAMPLED = 0.32
ROUNDS = 4


def least_common(n):
    """ceil(0.8 n) in whole numbers, of a column or array."""
    return (n * 80 + 99) // 100 if isinstance(n, (int, np.ndarray)) else F.floor((n * 80 + 99) / 100).cast("long")


def _sets(data, offsets, k=5):
    doc, token = distinct_sets(*Words(data, offsets).shingles(k))
    n = np.bincount(doc, minlength=len(offsets) - 1)
    ends = np.cumsum(n)
    total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(token), dtype=U64)))
    return doc, token, n, ends, mix(total[ends] - total[ends - n] + n.astype(U64))


def _in_sample(token):
    return (token >> U64(32)) < U64(int(SAMPLED * (1 << 32)))


def _describe(batches):
    for b in batches:
        data, offsets = text_buffer(b.column("text"))
        for i, j in slices(offsets):
            doc, token, n, ends, key = _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            sampled = np.bincount(doc[_in_sample(token)], minlength=j - i)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("h").slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(sampled.astype(np.int64)), pa.array(key.view(np.int64))], names=["doc_id", "h", "n", "sampled", "key"])


def _sampled_tokens(batches):
    """(token, key) of the sampled shingles; a set that a task has met before is left out."""
    seen: set[int] = set()
    for b in batches:
        data, offsets = text_buffer(b.column("text"))
        for i, j in slices(offsets):
            doc, token, n, _, key = _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            new = np.zeros(j - i, bool)
            for r, (x, m) in enumerate(zip(key.tolist(), n.tolist(), strict=True)):
                if m and x not in seen:
                    seen.add(x)
                    new[r] = True
            use = new[doc] & _in_sample(token)
            yield pa.RecordBatch.from_arrays([pa.array(token[use].view(np.int64)), pa.array(key[doc[use]].view(np.int64))], names=["token", "key"])


def _shared_counts(batches):
    """Rows (token, key) come in that order. Gives (key, shared): how many of its tokens another key has too, in parts.

    From batch to batch only the last token and key are held over, and whether that key still waits for a second one.
    """
    held, waits = None, False
    for b in batches:
        token, key = b.column("token").to_numpy(), b.column("key").to_numpy()
        n = len(token)
        if not n:
            continue
        new_token = np.concatenate(([True], token[1:] != token[:-1]))
        fresh = new_token.copy()
        fresh[1:] |= key[1:] != key[:-1]
        starts = np.flatnonzero(new_token)
        ends = np.append(starts[1:], n)
        many = key[starts] != key[ends - 1]
        out = []
        if held is not None and held[0] == token[0]:
            fresh[0] = key[0] != held[1]
            second = many[0] or fresh[0]
            many[0] |= second or not waits
            if waits and second:
                out.append(np.array([held[1]]))
            waits = waits and not second if len(starts) == 1 else not many[-1]
        else:
            waits = not many[-1]
        held = (token[-1], key[-1])
        keys, counts = np.unique(np.concatenate([*out, key[np.repeat(many, ends - starts) & fresh]]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts.astype(np.int64))], names=["key", "shared"])


def _full_sets(batches):
    for b in batches:
        data, offsets = text_buffer(b.column("text"))
        for i, j in slices(offsets):
            doc, token, n, ends, key = _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(token.view(np.int64)))
            some = np.flatnonzero(n)
            starts = (ends - n)[some]
            hashes = [np.minimum.reduceat(mix(token ^ U64(0x5851F42D4C957F2D * (r + 1) & (1 << 64) - 1)), starts) if len(starts) else token[:0] for r in range(ROUNDS)]
            low = [np.zeros(j - i, U64) for _ in range(ROUNDS)]
            for r in range(ROUNDS):
                low[r][some] = hashes[r]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64)), lists, *[pa.array(x.view(np.int64)) for x in low]], names=["key", "n", "tokens", *[f"low{r}" for r in range(ROUNDS)]])


def _linked(batches):
    """Pairs (a, b, ta, tb) whose token lists have Jaccard similarity of 0.8 at least."""
    for b in batches:
        ta, tb = b.column("ta"), b.column("tb")
        keep = np.zeros(b.num_rows, bool)
        for i in range(b.num_rows):
            x, y = ta[i].values.to_numpy(), tb[i].values.to_numpy()
            both = np.concatenate((x, y))
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            keep[i] = 100 * common >= 80 * (len(x) + len(y) - common)
        m = pa.array(keep)
        yield pa.RecordBatch.from_arrays([b.column("a").filter(m), b.column("b").filter(m)], names=["a", "b"])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys that link. A key with very many pairs is a skewed key of a plain join, which is split."""
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    sized = pairs.join(left, "a").join(right, "b").where((F.col("na") * 100 >= F.col("nb") * 80) & (F.col("nb") * 100 >= F.col("na") * 80))
    return sized.select("a", "b", "ta", "tb").mapInArrow(_linked, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    """The keys of pairs (a, b)."""
    return pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key")))


def links_within(sets: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Links and groups (key, grp) from buckets of ROUNDS min-hashes, the first alone and then the others.

    Each class is compared with the heads of its buckets that aren't in its group yet: under even min-hashes the class with the fewest shingles of
    its own, which is the original rather than a copy with edits; under odd ones one by hash. A group is a component of what links.
    """
    edges = sets.sparkSession.createDataFrame([], "a long, b long")
    groups = sets.select("key", F.col("key").alias("grp"))
    for phase in (range(1), range(1, ROUNDS)):
        pairs = None
        lows = sets.select("key", "n", "alone", *[f"low{r}" for r in phase]).join(groups, "key")
        for r in phase:
            rank = F.col("alone") if r % 2 == 0 else F.xxhash64("key", F.lit(r))
            low = lows.select("key", "n", "grp", "alone", F.col(f"low{r}").alias("low"))
            heads = low.groupBy("low").agg(F.min(F.struct(rank.alias("rank"), "key", "n", "grp")).alias("h"), F.count(F.lit(1)).alias("m")).where("m > 1").select("low", F.col("h.key").alias("b"), F.col("h.n").alias("nb"), F.col("h.grp").alias("head_grp"))
            # Sets whose sizes are too far apart can't link, so their tokens needn't travel.
            found = low.join(heads, "low").where("grp <> head_grp and n * 100 >= nb * 80 and nb * 100 >= n * 80").select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b"))
            pairs = found if pairs is None else pairs.union(found)
        at = f"{path}/within{phase[0]}"
        # A few classes have a pair; only their tokens are shuffled.
        pairs = save(pairs.distinct(), f"{at}/pairs")
        edges = edges.union(save(verify(pairs, sieve(sets, "key", _ends(pairs))), f"{at}/links"))
        labels = components(edges, at).select(F.col("id").alias("key"), "root")
        groups = save(sets.select("key").join(labels, "key", "left").select("key", F.coalesce("root", "key").alias("grp")), f"{at}/groups")
    return edges, groups


def _spread(rows: DataFrame) -> DataFrame:
    """rows (key, n, grp, token) with the least and the greatest group that has the token, and with `classes`, how many have it."""
    token = Window.partitionBy("token")
    return rows.select("token", "key", "n", "grp", F.min("grp").over(token).alias("low"), F.max("grp").over(token).alias("high"), F.count(F.lit(1)).over(token).alias("classes"))


def _told_apart(rows: DataFrame) -> DataFrame:
    """Rows (key, n, grp, token) of the tokens that several groups have, with `classes`, how many have it."""
    return _spread(rows).where("low <> high").drop("low", "high")


def _maybe_open(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """groups without the classes that can't share least_common(n) tokens with other groups, as more than n - least_common(n) sampled ones are their own group's."""
    sampled = sets.select("key", "n", F.filter("tokens", lambda t: F.shiftrightunsigned(t, 32) < int(SAMPLED * (1 << 32))).alias("tokens"))
    rows = sampled.join(groups, "key").select("key", "n", "grp", F.explode("tokens").alias("token"))
    own = _spread(rows).where("low = high").groupBy("key", "n").agg(F.count(F.lit(1)).alias("own"))
    return groups.join(own.where(F.col("own") > F.col("n") - least_common(F.col("n"))), "key", "left_anti")


def links_between(sets: DataFrame, groups: DataFrame, path: str, bound: bool = True) -> DataFrame:
    """All links between groups that the components need, by way of the token-group matrix.

    A class is open if it shares least_common(n) tokens with other groups. Behind the bound on group overlap, most that aren't are found by the sampled tokens, so
    that only tokens of the others are counted; what a class shares with closed ones only is no link. The prefixes are made once, as any fixed order of tokens serves for
    all passes. First up to HEADS passes compare with few classes of each prefix token, twice as many each time, and join what links, so that few groups that share tokens are left
    when the last pass compares what is left in full, behind the bound on group overlap unless that is waived (for sets so small that comparing is as
    cheap). A pass that joins less than a share of WORTH of the open classes is the last one of its kind.
    """
    edges = sets.sparkSession.createDataFrame([], "a long, b long")
    if bound:
        groups = save(_maybe_open(sets, groups), f"{path}/maybe")
        sets = sieve(sets, "key", groups.select("key"))
    told = _told_apart(sets.join(groups, "key").select("key", "n", "grp", F.explode("tokens").alias("token")))
    rows = save(_placed(told), f"{path}/open_rows")
    open_ = save(rows.select("key").distinct(), f"{path}/open")
    n_open = open_.count()
    if not n_open:
        return edges
    # Only open classes are compared from here on, so only their tokens need travel, in whichever pass.
    sets = save(sieve(sets.select("key", "n", "tokens"), "key", open_).join(open_, "key"), f"{path}/open_sets")
    groups = save(groups.join(open_, "key"), f"{path}/open_groups")
    prefix = save(rows.where(F.col("place") <= F.col("n") - least_common(F.col("n")) + 1), f"{path}/prefix")
    for i in range(HEADS):
        at = f"{path}/pass{i}"
        found = save(_with_heads(prefix, sets, i), f"{at}/found")
        n_found = found.count()
        if n_found:
            edges = edges.union(found)
            of = lambda c, g: groups.select(F.col("key").alias(c), F.col("grp").alias(g))
            joined = components(found.join(of("a", "ga"), "a").join(of("b", "gb"), "b").select(F.col("ga").alias("a"), F.col("gb").alias("b")), at).withColumnRenamed("id", "grp")
            groups = save(groups.join(joined, "grp", "left").select("key", F.coalesce("root", "grp").alias("grp")), f"{at}/groups")
            # A token whose classes are all in one group by now has no more to tell.
            token = Window.partitionBy("token")
            now = prefix.drop("grp").join(groups, "key").select("*", F.min("grp").over(token).alias("low"), F.max("grp").over(token).alias("high"))
            prefix = save(now.where("low <> high").drop("low", "high"), f"{at}/prefix")
        if n_found < WORTH * n_open:
            break
    return edges.union(_in_full(prefix, groups, sets, path, bound))


HEADS, WORTH = 5, 0.01
#: Of two that link, the smaller has the first common token among its first n/9 + 1, and as many tokens follow it in both as are common.
_FITS = "na * 100 >= nb * 80 and nb * 100 >= na * 80 and (1 + least(na - pa, nb - pb)) * 9 >= 4 * (na + nb)"


def _placed(told: DataFrame) -> DataFrame:
    """(token, key, n, grp, place) of open classes: their tokens that several groups have, with the place of each, rarest first.

    Tokens of one group only can't be common with another; they come first and fill up the prefix, which is a class's first n - least_common(n) + 1.
    """
    mine = Window.partitionBy("key").orderBy("classes", "token")
    whole = mine.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    open_ = told.withColumn("shared", F.count(F.lit(1)).over(whole)).where(F.col("shared") >= least_common(F.col("n")))
    return open_.select("token", "key", "n", "grp", (F.col("n") - F.col("shared") + F.row_number().over(mine)).alias("place"))


def _with_heads(prefix: DataFrame, sets: DataFrame, i: int) -> DataFrame:
    """Links of classes with 2^i classes of each prefix token: the one with the fewest rarer tokens at first, then others by hash among those that fit."""
    rank = F.col("place") if i == 0 else F.struct(F.col("place") * 9 > F.col("n") + 9, F.xxhash64("key", "token", "draw"))
    drawn = prefix.withColumn("draw", F.explode(F.sequence(F.lit(1 << i), F.lit((2 << i) - 1))))
    head = drawn.groupBy("token", "draw").agg(F.min(F.struct(rank.alias("rank"), "key", "n", "grp", "place")).alias("h"))
    head = head.select("token", F.col("h.key").alias("b"), F.col("h.n").alias("nb"), F.col("h.grp").alias("other"), F.col("h.place").alias("pb")).distinct()
    pairs = prefix.select("token", F.col("key").alias("a"), F.col("n").alias("na"), "grp", F.col("place").alias("pa")).join(head, "token").where(f"grp <> other and {_FITS}")
    return verify(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets)


def _in_full(prefix: DataFrame, groups: DataFrame, sets: DataFrame, path: str, bound: bool) -> DataFrame:
    left = prefix.where("place * 9 <= n + 9").select("token", F.col("key").alias("a"), F.col("n").alias("na"), "grp", F.col("place").alias("pa"))
    right = prefix.select("token", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("grp").alias("other"), F.col("place").alias("pb"))
    pairs = save(left.join(right, "token").where(f"grp <> other and (na < nb or na = nb and a < b) and {_FITS}").select("a", "b", "other").distinct(), f"{path}/pairs")
    if pairs.isEmpty():
        return pairs.select("a", "b")
    if bound:
        # The overlap of a class with the union of a group bounds that with each member. Only classes with a candidate and members of candidates, which are few by
        # now, are looked up, by class; tokens of one group only are among theirs, but none of these is common to two groups.
        candidates = save(pairs.select(F.col("a").alias("key"), "other").distinct(), f"{path}/candidates")
        members = save(groups.withColumnRenamed("grp", "other").join(candidates.select("other").distinct(), "other"), f"{path}/members")
        matrix = sieve(sets, "key", members.select("key")).join(members, "key").select("other", F.explode("tokens").alias("token")).distinct()
        mine = sieve(sets, "key", candidates.select("key")).join(candidates, "key").select("key", "n", "other", F.explode("tokens").alias("token"))
        overlap = mine.join(matrix, ["token", "other"]).groupBy("key", "n", "other").agg(F.count(F.lit(1)).alias("common"))
        opened = overlap.where(F.col("common") >= least_common(F.col("n"))).select(F.col("key").alias("a"), "other")
        pairs = save(pairs.join(opened, ["a", "other"]), f"{path}/opened")
    sets = sieve(sets, "key", _ends(pairs))
    # One comparison of each class with each group first; what these join needs no further one.
    first = save(verify(pairs.groupBy("a", "other").agg(F.min("b").alias("b")).select("a", "b"), sets), f"{path}/first")
    merged = components(first, f"{path}/merge")
    tag = lambda c: merged.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
    rest = pairs.join(tag("a"), "a", "left").join(tag("b"), "b", "left").where("not (ra <=> rb) or ra is null").select("a", "b")
    return first.union(save(verify(rest, sets), f"{path}/rest"))


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), n (shingles), root (of the component; null without shingles), component_id of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    path = work_dir(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    rows = save(docs.mapInArrow(_describe, "doc_id long, h long, n long, sampled long, key long"), f"{path}/rows")
    named = F.coalesce("doc_id", F.lit(-(1 << 63)))
    classes = save(rows.where("n > 0").groupBy("key").agg(F.min("n").alias("n"), F.min("sampled").alias("sampled"), F.min("doc_id").alias("least"), F.min(named).alias("pick")), f"{path}/classes")

    tokens = docs.mapInArrow(_sampled_tokens, "token long, key long").repartition("token").sortWithinPartitions("token", "key")
    shared = tokens.mapInArrow(_shared_counts, "key long, shared long").groupBy("key").agg(F.sum("shared").alias("shared"))
    alone = F.col("sampled") - F.coalesce("shared", F.lit(0))
    left = save(classes.join(shared, "key", "left").where(alone <= F.col("n") - least_common(F.col("n"))).select("key", "pick", alone.alias("alone")), f"{path}/left")
    # One document of each class that is left gives its set.
    picks = save(left.select("pick").distinct(), f"{path}/picks")
    # Inner joins with distinct keys: a semi join would be carried out below the sieve.
    sets = sieve(docs.where("text is not null").withColumn("pick", named), "pick", picks).join(picks, "pick").select("text")
    sets = sets.mapInArrow(_full_sets, "key long, n long, tokens array<long>, " + ", ".join(f"low{r} long" for r in range(ROUNDS)))
    sets = save(sets.dropDuplicates(["key"]).join(left.select("key", "alone"), "key"), f"{path}/sets")

    edges, groups = links_within(sets, path)
    edges = edges.union(links_between(sets, groups, path))
    labels = components(edges, f"{path}/all").select(F.col("id").alias("key"), "root")
    rooted = classes.select("key", "least").join(labels, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = save(rooted.join(least, "root").select("key", "root", "component_id"), f"{path}/names")
    some = rows.where("n > 0").join(names, "key").select("doc_id", "h", "n", "root", "component_id")
    return some.unionByName(rows.where("n = 0").select("doc_id", "h", "n", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id")))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (doc_id, text)."""
    return labelled(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """Rows of docs, one of each component, with all their columns.

    The row of least doc_id stays (a null one last), and of rows that repeat it, the first by hash of their text. Rows without a shingle all
    stay, as they are linked with nothing.
    """
    last = F.lit((1 << 63) - 1)
    d, h, k = fresh(docs, "d", "h", "k")
    row = F.struct(F.coalesce(F.col("doc_id").cast("long"), last).alias("d"), "h")
    stay = labelled(docs).where("n > 0").groupBy("root").agg(F.min(row).alias("r"))
    stay = stay.select(F.col("r.d").alias(d), F.col("r.h").alias(h)).distinct()
    bare = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    full = docs.where(~bare).withColumn(d, F.coalesce(F.col("doc_id").cast("long"), last)).withColumn(h, F.xxhash64("text"))
    met = full.join(stay, [d, h]).withColumn(k, F.row_number().over(Window.partitionBy(d, h).orderBy(h)))
    return met.where(F.col(k) == 1).select(*docs.columns).unionByName(docs.where(bare))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
