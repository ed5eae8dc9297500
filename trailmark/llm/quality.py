"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled of good quality; the unlabelled set is a sample of all documents,
whatever their labels. A logistic model over counted text features minimises the non-negative unbiased risk

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

with logistic loss. The class prior is estimated as the share of positives among the labelled training rows. At most
`MOST_ROWS` positives and `MOST_ROWS` unlabelled documents, those of least hash of id and text, are read for fitting (the documented bound on what the
driver holds: two matrices of MOST_ROWS by about 40 numbers); every document is scored, in one pass without a shuffle.

Defined cases: null and empty texts have features all 0 and the score these give; rows that repeat id and text, and labels that repeat, count
once in fitting; rows of one id that differ in text each count; labels without a document don't matter; without any positive the score is the prior (1 where there are no labels at all); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD_BYTE, Words, bounded_sample, documents, slices, text_buffer

MOST_ROWS = 20_000

_MARKS = b"!|*#$%&@.,;:'\"-_/\\()[]{}<>=+~^`?"
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[~WORD_BYTE] = 4
_CLASS[0x0A] = 5
for _i, _c in enumerate(_MARKS):
    _CLASS[_c] = 6 + _i
_N_CLASS = 6 + len(_MARKS)
FEATURES = _N_CLASS - 1 + 9


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers for each document: shares of byte classes, word shape and repetition."""
    n_docs = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n_docs), size)
    counts = np.bincount(owner * _N_CLASS + _CLASS[data], minlength=n_docs * _N_CLASS).reshape(n_docs, _N_CLASS)
    out = np.zeros((n_docs, FEATURES))
    out[:, : _N_CLASS - 1] = counts[:, 1:] / np.maximum(size, 1)[:, None]
    w = Words(data, offsets)
    first = w.first_of_doc()
    n_words = np.diff(first)
    each = np.maximum(n_words, 1)
    total = lambda x: np.bincount(w.doc, x, minlength=n_docs) / each
    length = (w.end - w.start).astype(float)
    raw = data[w.start] if len(w.start) else data[:0]
    tail = data[w.end - 1] if len(w.end) else data[:0]
    again = np.zeros(len(w.hash))
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    order = np.lexsort((w.hash, w.doc))
    new = np.ones(len(order), bool)
    new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    distinct = np.bincount(w.doc[order][new], minlength=n_docs)
    at = _N_CLASS - 1
    out[:, at] = np.log1p(n_words)
    out[:, at + 1] = total(length) / 10
    out[:, at + 2] = total(again)
    out[:, at + 3] = distinct / each
    out[:, at + 4] = distinct / np.sqrt(each)
    out[:, at + 5] = total((_CLASS[raw] >= 6).astype(float))
    out[:, at + 6] = total((_CLASS[tail] >= 6).astype(float))
    out[:, at + 7] = total((length == 1).astype(float))
    out[:, at + 8] = n_words > 0
    return out


def _over(batches, each):
    for b in batches:
        data, offsets = text_buffer(b.column(b.schema.get_field_index("text")))
        for i, j in slices(offsets):
            yield b.slice(i, j - i), each(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _featurize(batches):
    for b, x in _over(batches, features):
        yield pa.RecordBatch.from_arrays([b.column("kind"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))], names=["kind", "x"])


def _expand(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / sd, -8, 8)
    return np.concatenate([z, np.minimum(z * z, 16.0), np.ones((len(z), 1))], axis=1)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -60, 60)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 1e-4) -> dict:
    """Weights that minimise the non-negative unbiased risk, by Adam over all rows.

    Where the negative part falls below 0, the step goes up its slope instead, as the method has it.
    """
    mean, sd = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    p, u = _expand(positive, mean, sd), _expand(unlabelled, mean, sd)
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        negative = -np.log(np.maximum(1 - su, 1e-12)).mean() + prior * np.log(np.maximum(1 - sp, 1e-12)).mean()
        slope = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        g = prior * (p.T @ (sp - 1)) / len(p) + slope if negative >= 0 else -slope
        g = g + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return {"mean": mean, "sd": sd, "w": w}


def crc32_of_id(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> dict:
    """A model from labels (doc_id, quality), which are training rows only, and docs (doc_id, text)."""
    labels = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    n, share = labels.agg(F.count(F.lit(1)), F.avg(F.col("quality").cast("double"))).first()
    prior = min(0.999, max(0.001, share)) if n else 1.0
    # At most `most` ids, hence the broadcast; rows are bounded after the join, as many may share an id.
    good = bounded_sample(labels.where("quality = 1").select("doc_id").distinct(), most, ["doc_id"])
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    positive = bounded_sample(docs.join(F.broadcast(good), "doc_id"), most, ["doc_id", "text"]).select(F.lit(1).alias("kind"), "text")
    any_ = bounded_sample(docs, most, ["doc_id", "text"]).select(F.lit(0).alias("kind"), "text")
    rows = positive.unionAll(any_).mapInArrow(_featurize, "kind int, x array<double>").toPandas()
    x = np.array(rows["x"].tolist()).reshape(-1, FEATURES)
    kind = rows["kind"].to_numpy()
    if not (kind == 1).any() or not (kind == 0).any():
        return {"constant": prior}
    order = np.lexsort((*x.T, kind))  # the same model whatever the order of the rows
    x, kind = x[order], kind[order]
    return fit_nnpu(x[kind == 1], x[kind == 0], prior)


def _scorer(model: dict, name: str):
    def score(batches):
        for b, x in _over(batches, features):
            s = np.full(len(x), model["constant"]) if "constant" in model else _sigmoid(_expand(x, model["mean"], model["sd"]) @ model["w"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, name])

    return score


def score_documents(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """docs with a column of that name (0 to 1), which takes the place of one they have; docs keep their other columns, of which text is read."""
    docs = docs.drop(name)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_scorer(model, name), f"{schema}, `{name}` double")


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return labels.where(crc32_of_id(F.col("doc_id")) % 3 != 1)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, training_labels(spark, sf_dir))
    held = (crc32_of_id(F.col("doc_id")) % 3 == 1).alias("held_out")
    return score_documents(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
