"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers read the tokens of a clause: insult (a lexicon, each term with its own weight), threat (a
verb of harm soon before a target), target, negation and reported speech. They are composed once into one machine over
symbol classes; its output at an insult or a threat is the product of the factors of the states it is in, so
"not an idiot" and "he said 'idiot'" count less and "you idiot" more than the word alone. A document's score is a logistic function of
what its matched clauses give.

The lexicon has a short fixed list and what training rows show: words and word beginnings (4 to 7 letters, with *) that occur in toxic
documents `LIFT` times as often as in others. Weights are fitted by logistic regression on matched clauses. At most
`MOST_ROWS` labelled rows, those of least hash, are read for fitting, and at most `MOST_TERMS` terms are kept (documented bounds of what the
driver holds). Scoring is one pass over all documents without a shuffle.

Defined cases: null and empty texts match nothing and have the score of that; labels without a document don't matter; without
training rows the fixed list has fixed weights; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import crc32_of_id
from .shared import bounded_sample, documents, save, work_dir

MOST_ROWS, MOST_TERMS, LEAST_DOCS, LIFT = 20_000, 256, 4, 6.0

INSULTS = frozenset("idiot moron stupid fool loser scum trash pathetic worthless disgusting clown imbecile jerk".split())
THREATS = frozenset("kill hurt destroy beat punish crush attack shoot".split())
TARGETS = frozenset("you your yours he she they him her them".split())
NEGATIONS = frozenset("not no never isn aren wasn don doesn didn without".split())
REPORTS = frozenset("said says called wrote quoted according reported".split())

_TOKEN = re.compile(r'[^\W\d_]+|[.;:!?\n|"«»]')
_ENDS = frozenset('.;:!?\n|"«»')
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)


class Machine:
    """A transducer over symbol classes: step[state][symbol] -> state, and the factor of an output in each state."""

    def __init__(self, step: list[list[int]], factor: list[float], fires: set[tuple[int, int]] = frozenset()):
        self.step, self.factor, self.fires = step, factor, fires

    def compose(self, other: Machine) -> Machine:
        """Both at once: states are pairs, factors multiply, either one's arcs fire."""
        n, symbols = len(other.step), range(len(self.step[0]))
        pairs = [(a, b) for a in range(len(self.step)) for b in range(n)]
        step = [[self.step[a][s] * n + other.step[b][s] for s in symbols] for a, b in pairs]
        fires = {(a * n + b, s) for a, b in pairs for s in symbols if (a, s) in self.fires or (b, s) in other.fires}
        return Machine(step, [self.factor[a] * other.factor[b] for a, b in pairs], fires)


def _holds(symbol: int, length: int | None, factor: float) -> Machine:
    """After symbol, outputs have the factor for so many tokens, or to the clause's end."""
    if length is None:
        return Machine([[1 if s == symbol else q for s in range(6)] for q in range(2)], [1.0, factor])
    return Machine([[length if s == symbol else max(0, q - 1) for s in range(6)] for q in range(length + 1)], [1.0] + [factor] * length)


def grammar() -> Machine:
    negation, reported, target = _holds(NEGATION, 3, 0.25), _holds(REPORT, None, 0.5), _holds(TARGET, None, 1.5)
    threat = _holds(THREAT, 3, 1.0)
    threat.fires = {(q, TARGET) for q in (1, 2, 3)}
    insult = Machine([[0] * 6], [1.0], {(0, INSULT)})
    return insult.compose(threat).compose(target).compose(negation).compose(reported)


#: Features before those of the terms: fixed insults, threats, matched clauses, their share of clauses.
_FIXED = 4


class Matcher:
    def __init__(self, terms: list[str]):
        self.words = {t: _FIXED + i for i, t in enumerate(terms) if t[-1] != "*"}
        self.stems = {t[:-1]: _FIXED + i for i, t in enumerate(terms) if t[-1] == "*"}
        self.lengths = sorted({len(t) for t in self.stems})
        self.machine = grammar()
        self.known: dict[str, tuple[int, tuple[int, ...]]] = {}

    def _meaning(self, w: str) -> tuple[int, tuple[int, ...]]:
        terms = [self.words[w]] if w in self.words else []
        terms += [self.stems[w[:k]] for k in self.lengths if w[:k] in self.stems and len(w) > k]
        terms += [0] if w in INSULTS else []
        symbol = INSULT if terms else next((s for s, x in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) if w in x), OTHER)
        return symbol, tuple(terms)

    def features(self, text: str) -> dict[int, float]:
        tokens = _TOKEN.findall(text.lower())
        known = self.known
        if len(known) > 200_000:
            known.clear()
        distinct = set(tokens)
        for w in distinct:
            if w not in known:
                known[w] = self._meaning(w)
        if not any(known[w][0] in (INSULT, THREAT) for w in distinct):
            return {}
        out: Counter = Counter()
        state, matched, clauses, hit = 0, 0, 1, False
        step, factor, fires = self.machine.step, self.machine.factor, self.machine.fires
        for w in tokens:
            if w in _ENDS:
                matched, clauses, state, hit = matched + hit, clauses + 1, 0, False
                continue
            symbol, terms = known[w]
            if (state, symbol) in fires:
                hit = True
                for t in terms if symbol == INSULT else (1,):
                    out[t] += factor[state]
            state = step[state][symbol]
        matched += hit
        if not out:
            return {}
        return {k: min(3.0, v) for k, v in out.items()} | {2: float(np.log1p(matched)), 3: matched / clauses}


def _count_terms(batches):
    for b in batches:
        counts: Counter = Counter()
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            words = {w for w in _TOKEN.findall((text or "").lower()) if 3 <= len(w) <= 24}
            terms = words | {w[:k] + "*" for w in words for k in range(4, 8) if len(w) > k}
            counts.update((t, toxic) for t in terms)
        terms = sorted({t for t, _ in counts})
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[t, 1] for t in terms], pa.int64()), pa.array([counts[t, 0] for t in terms], pa.int64())], names=["term", "bad", "good"])


def _examples(terms: list[str]):
    def make(batches):
        m = Matcher(terms)
        for b in batches:
            rows = [m.features(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("toxic"), pa.array([list(r) for r in rows], pa.list_(pa.int32())), pa.array([[float(x) for x in r.values()] for r in rows], pa.list_(pa.float64()))],
                names=["doc_id", "toxic", "at", "x"],
            )

    return make


def learn_terms(rows: DataFrame) -> list[str]:
    """Terms of rows (text, toxic) that mark toxic documents, strongest first."""
    bad, good = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    counts = rows.select("text", "toxic").mapInArrow(_count_terms, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    lift = ((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("good") + 0.5) / (good + 1))
    found = counts.where((F.col("bad") >= LEAST_DOCS) & (lift >= LIFT)).withColumn("weight", F.round(F.col("bad") * F.log(lift), 6))
    # Beginnings that say no more than a longer term does are left out.
    found = found.groupBy("weight", "bad", "good").agg(F.max_by("term", F.struct(F.length(F.rtrim(F.regexp_replace("term", r"\*", ""))), "term")).alias("term"))
    return [r["term"] for r in found.orderBy(F.desc("weight"), "term").limit(MOST_TERMS).collect()]


def fit(x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.1, l2: float = 2e-4) -> np.ndarray:
    """Logistic regression by Adam over all rows; the last weight is the constant."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    w = np.zeros(x.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        g = x.T @ (p - y) / len(y) + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """A model from labels (doc_id, toxic), which are training rows only, and docs (doc_id, text)."""
    labels = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    some = bounded_sample(labels.distinct(), MOST_ROWS, ["doc_id", "toxic"])
    # At most MOST_ROWS labels, hence the broadcast; rows are bounded after the join, as many may share an id.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")
    rows = save(bounded_sample(rows, MOST_ROWS, ["doc_id", "toxic", "text"]), work_dir(docs.sparkSession, "toxicity"))
    terms = learn_terms(rows)
    made = rows.mapInArrow(_examples(terms), "doc_id long, toxic int, at array<int>, x array<double>").toPandas().sort_values(["doc_id", "toxic"])
    n = _FIXED + len(terms)
    if not len(made) or made["toxic"].nunique() < 2:
        return {"terms": [], "w": np.array([2.0, 2.0, 0.5, 1.0, -2.5])}
    x = np.zeros((len(made), n), np.float32)
    for i, (at, v) in enumerate(zip(made["at"], made["x"], strict=True)):
        x[i, at] = v
    return {"terms": terms, "w": fit(x, made["toxic"].to_numpy(float))}


def _scorer(model: dict):
    def score(batches):
        m, w = Matcher(model["terms"]), model["w"]
        for b in batches:
            at = b.schema.get_field_index("text")
            s = []
            for i in range(0, b.num_rows, 1000):
                s += [w[-1] + sum(w[k] * v for k, v in m.features(t or "").items()) for t in b.column(at).slice(i, 1000).to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(np.array(s, float), -60, 60)))
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(b.columns) if i != at], pa.array(p)], names=[*[x for x in b.schema.names if x != "text"], "score"])

    return score


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """docs without text, with a column score (0 to 1), which takes the place of one they have."""
    docs = docs.drop("score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(_scorer(model), f"{schema}, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    part = crc32_of_id(F.col("doc_id")) % 5
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(part != 0)
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", (part == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
