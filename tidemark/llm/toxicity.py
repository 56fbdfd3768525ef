"""Toxicity: a logistic classifier over words and their starts, regularised by swapped identity terms."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, map_batches, pieces, table

#: Terms of one group take each other's place, each that of the one before it.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("she", "he"), ("her", "his"), ("mothers", "fathers"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("black", "white", "asian", "latino", "arab"),
    ("african", "european", "american", "mexican", "chinese", "indian"), ("immigrants", "natives"), ("refugees", "citizens"), ("old", "young"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)
#: Labelled rows that are learned from (about so many, drawn by hash), the most features, and the chi-squared that each needs.
SAMPLE, FEATURES, LEAST_CHI2 = 20_000, 4096, 12.0
#: Letters of the word starts that are features.
STARTS = range(2, 10)
#: Weight of squared score changes under swaps, of squared weights, and the steps of the fit.
SWAP_PENALTY, RIDGE, STEPS = 20.0, 2e-4, 400
THRESHOLD = 0.3
#: Entries that a task's table of counts or of known words may have before it is emptied.
TABLE = 1 << 16

_SWAP = {t: g[(i + 1) % len(g)] for g in IDENTITY_TERMS for i, t in enumerate(g)}
_WORD = re.compile(r"[^\W\d_]+")
_TERM = re.compile(r"(?<!\w)(?:" + "|".join(sorted(_SWAP, key=len, reverse=True)) + r")(?!\w)")


def plain(text: str | None) -> str:
    return (text or "").lower()


def swapped(text: str) -> str | None:
    """A lower-case text with every identity term exchanged for another of its group; None if it has none."""
    out, n = _TERM.subn(lambda m: _SWAP[m[0]], text)
    return out if n else None


def words(text: str) -> set[str]:
    return set(_WORD.findall(text))


def features_of(word: str) -> list[str]:
    """The word itself, and its starts where it goes on."""
    return [word + "$", *(word[:k] for k in STARTS if len(word) > k)]


class Model:
    """Features with weights; a text's score is the logistic of the sum over those present, each once."""

    def __init__(self, features: list[str], weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias

    def reader(self) -> Reader:
        return Reader(self.features)

    def scores(self, texts: list[str | None], reader: Reader) -> np.ndarray:
        z = np.array([self.bias + self.weights[reader(plain(t))].sum() if t else self.bias for t in texts])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Reader:
    """Places of the features that a lower-case text has, ascending. Words that came before are looked up."""

    def __init__(self, features: list[str]):
        self.at = {f: i for i, f in enumerate(features)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> np.ndarray:
        out: set[int] = set()
        for w in words(text):
            got = self.known.get(w)
            if got is None:
                if len(self.known) >= TABLE:
                    self.known.clear()
                got = self.known[w] = tuple(self.at[f] for f in features_of(w) if f in self.at)
            if got:
                out.update(got)
        return np.array(sorted(out), np.int64)


def fit(rows: list[np.ndarray], labels: np.ndarray, swaps: list[tuple[int, np.ndarray]], n: int) -> tuple[np.ndarray, float]:
    """Weights and bias: log loss + RIDGE |w|^2 + SWAP_PENALTY * mean squared change of the score under swaps.

    rows: features of each labelled text; swaps: (row, its features after the swap). Adam on the whole sample.
    """
    w, bias, m, v = np.zeros(n), 0.0, np.zeros(n + 1), np.zeros(n + 1)
    if not len(rows) or labels.min() == labels.max():
        return w, float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))) if len(rows) else 0.0
    bias = float(np.log(labels.mean() / (1 - labels.mean())))
    at = lambda xs: (np.repeat(np.arange(len(xs)), [len(x) for x in xs]), np.concatenate([*xs, np.zeros(0, np.int64)]).astype(np.int64))
    ri, ci = at(rows)
    si, sc = at([x for _, x in swaps])
    oi, oc = at([rows[i] for i, _ in swaps])
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-(np.bincount(ri, w[ci], len(rows)) + bias)))
        g = (p - labels) / len(rows)
        grad = np.bincount(ci, g[ri], n) + 2 * RIDGE * w
        moved = 0.0
        if swaps:
            new, old = (1 / (1 + np.exp(-(np.bincount(i, w[c], len(swaps)) + bias))) for i, c in ((si, sc), (oi, oc)))
            change = 2 * SWAP_PENALTY / len(swaps) * (new - old)
            up, down = change * new * (1 - new), change * old * (1 - old)
            grad += np.bincount(sc, up[si], n) - np.bincount(oc, down[oi], n)
            moved = (up - down).sum()
        full = np.append(grad, g.sum() + moved)
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def learn(ws: Workspace, docs: DataFrame, labels: DataFrame) -> Model:
    """The model of labels (doc_id, toxic 0 or 1) over docs (doc_id, text).

    About SAMPLE labelled rows are learned from, drawn by the hash of doc_id; of several labels of a document, 1
    holds. The words and word starts that tell the labels apart best, by chi-squared over the sample, are the features. Sample rows
    with identity terms are paired with their swapped text. Without rows, or with one label only, the score is the
    prior everywhere.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    scale, n = 1 << 40, known.count()
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < F.lit(min(scale, scale * SAMPLE // max(n, 1))))
    # About SAMPLE ids, whatever the table's size; of a repeated id's texts one is learned from.
    of_id = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = ws.save(of_id.select("text", "toxic"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array([x[0] for x in seen.values()], pa.int32()), pa.array([x[1] for x in seen.values()], pa.int32())], ["f", "neg", "pos"])
            seen.clear()
            return out

        for b in pieces(batches):
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for f in {f for w in words(plain(text)) for f in features_of(w)}:
                    seen.setdefault(f, [0, 0])[toxic] += 1
                if len(seen) >= TABLE:
                    yield flush()
        yield flush()

    by_label = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    neg, pos = float(by_label.get(0, 0)), float(by_label.get(1, 0))
    if not neg or not pos:
        return Model([], np.zeros(0), float(np.log((pos + 0.5) / (neg + 0.5))) if neg + pos else 0.0)
    sums = map_batches(rows, count, "f string, neg int, pos int").groupBy("f").agg(F.sum("neg").cast("double").alias("neg"), F.sum("pos").cast("double").alias("pos")).where("neg + pos >= 3")
    chi2 = F.pow(F.col("pos") * neg - F.col("neg") * pos, 2) * (neg + pos) / ((F.col("pos") + F.col("neg")) * (neg + pos - F.col("pos") - F.col("neg") + 1) * neg * pos)
    best = sorted(r.f for r in sums.withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2).orderBy(F.col("chi2").desc(), "f").limit(FEATURES).collect())
    model = Model(best, np.zeros(len(best)), 0.0)

    packed = lambda x: x.astype("<i4").tobytes()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = model.reader()
        for b in pieces(batches):
            texts = [plain(x) for x in b.column(0).to_pylist()]
            other = [None if (s := swapped(x)) is None else packed(read(s)) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([packed(read(x)) for x in texts], pa.binary()), pa.array(other, pa.binary())], ["toxic", "own", "other"])

    found = [(r.toxic, bytes(r.own), None if r.other is None else bytes(r.other)) for r in map_batches(rows, features, "toxic int, own binary, other binary").collect()]
    found.sort(key=lambda r: (r[0], r[1], r[2] or b""))
    places = lambda x: np.frombuffer(x, "<i4").astype(np.int64)
    w, bias = fit([places(x) for _, x, _ in found], np.array([y for y, _, _ in found], float), [(i, places(x)) for i, (_, _, x) in enumerate(found) if x is not None], len(best))
    return Model(best, w, bias)


def score(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text") -> DataFrame:
    """The named columns of docs and then `score`, from 0 to 1, of every whole text.

    A null or empty text has the prior's score. Repeated rows each give a row; an empty table gives none. The columns may
    have any name; one named score stands before the score, which then is the last column.
    """
    names = [f"__s{i}" for i in range(len(columns))]
    kept = docs.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = model.reader()
        for b in pieces(batches):
            scored = model.scores(b.column(b.num_columns - 1).to_pylist(), read)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scored)], [*names, "__score"])

    return map_batches(kept, run, kept.drop("__text").schema.add("__score", "double")).toDF(*columns, "score")


def _learned(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Model:
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return learn(Workspace(spark), docs, labels)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that score under THRESHOLD."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    scored = score(docs.toDF(*names), _learned(spark, sf_dir, table(spark, sf_dir, "documents")), names, text)
    return scored.where(F.col("score") < THRESHOLD).select(*names).toDF(*docs.columns)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    scored = score(docs, _learned(spark, sf_dir, docs), ["doc_id"])
    return scored.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
