"""Quality classifier: random Fourier features, ridge regression by normal equations, isotonic calibration.

A text becomes ``FEATURES`` statistics, standardised over the training rows. Random Fourier features (cosines of random
projections, fixed by a seed) turn a linear model on them into one with a Gaussian kernel. Each training partition sums
its part of the normal equations; the sums are added and solved once. Held-back training rows then fix the calibration:
their scores are counted in a grid of bins by Spark and made monotone by pooling adjacent violators.

Bounds: at most ``sample`` labelled rows train (those whose hashed doc_id is smallest; all of them if there are fewer),
spread over ``FIT_TASKS`` tasks, so what reaches the driver (one sum per task, one count per bin) has a fixed size, and
so has the broadcast table of sampled labels. Every row is scored, in one pass without a shuffle.

Defined results: null and empty texts have zero statistics and are scored like others. Labels without a value or doc_id
are left out; of several labels of a document the smallest counts. Without training rows every score is 0.5, with one
class all scores lean to it. Rows that repeat get equal scores. Extra columns are left behind by ``score``. An empty
table gives no rows.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.columns import id_and_text, slices
from inkstone.runtime import cut_lineage

FEATURES = 16
FIT_TASKS = 16
BINS = 2000
SYMBOLS = "#*$%&|<>@=_~^"


def statistics(text: str) -> list[float]:
    """Statistics of one text, about as large as one another."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    chars = max(1, sum(map(len, words)))
    symbols = [text.count(c) for c in SYMBOLS]
    stops = sum(map(text.count, (". ", "! ", "? ", ".\n"))) + 1
    lines = text.split("\n")
    ended = sum(x.rstrip()[-1:] in ".!?" for x in lines if x)
    return [
        float(np.log1p(n)),
        chars / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        sum(map(str.isalpha, words)) / n,
        len(set(words)) / n,
        len(set(words)) / n**0.7,
        sum(map(operator.eq, words, words[1:])) / n,
        sum(symbols) / n,
        text.count("|") / n,
        text.count("!!") / n,
        text.count(",") / n,
        float(np.log1p(n / stops)),
        len(set(lines)) / len(lines),
        ended / len(lines),
        float(np.log1p(len(lines))),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, x``: the statistics of each row's text."""

    def run(batches):
        for batch in slices(batches):
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, x array<double>")


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame, sample: int = 200_000, label: str = "quality") -> DataFrame:
    """``doc_id, y`` of at most about ``sample`` training documents."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.min(label).cast("double").alias("y"))
    total = usable.count()
    if total > sample:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample / total))
    return usable


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    values: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of standardised statistics, with a constant."""
        z = np.clip((x - self.mean) / self.scale, -3, 3)
        waves = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.projection + self.phase)
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a hundredth of the ridge score orders rows within a step."""
        raw = self.raw(x)
        if not len(self.edges):
            return np.full(len(x), 0.5)
        return np.clip(0.99 * np.interp(raw, self.edges, self.values) + 0.01 * np.clip(raw, 0, 1), 0, 1)


def pool(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence closest to ``y`` in weighted squares."""
    blocks: list[list[float]] = []
    for value, w in zip(y.tolist(), weight.tolist(), strict=True):
        blocks.append([value, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else np.empty(0)


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def fit(feats: DataFrame, labels: DataFrame, sample: int = 200_000, width: int = 200, gamma: float = 0.08, ridge: float = 1e-3, seed: int = 7) -> Model:
    """Train on the features whose documents have a label and are not held out."""
    wanted = training_labels(labels, sample)
    rows = feats.join(F.broadcast(wanted), "doc_id").withColumn("check", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(4)) == 0)
    rows = cut_lineage(rows.repartition(FIT_TASKS))
    train, check = rows.where(~F.col("check")), rows.where("check")
    moments = train.agg(*[f(F.col("x")[i]).alias(f"{f.__name__}{i}") for f in (F.avg, F.stddev_pop) for i in range(FEATURES)]).first()
    mean, scale = np.array([v or 0.0 for v in moments], float).reshape(2, FEATURES)
    rng = np.random.default_rng(seed)
    projection = rng.normal(0, np.sqrt(2 * gamma), (FEATURES, width))
    model = Model(mean, np.maximum(scale, 1e-3), projection, rng.uniform(0, 2 * np.pi, width), np.zeros(width + 1), np.empty(0), np.empty(0))

    def part(batches):
        size = width + 1
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = model.lift(_matrix(batch))
            total[:, :size] += z.T @ z
            total[:, size] += z.T @ batch.column("y").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    sums = sum(np.frombuffer(r.part).reshape(width + 1, width + 2) for r in train.select("x", "y").mapInArrow(part, "part binary").collect())
    n = float(sums[-1, -2])
    if n == 0:
        return model
    model.weights = np.linalg.solve(sums[:, :-1] + ridge * n * np.eye(width + 1), sums[:, -1])

    def bins(batches):
        for batch in batches:
            at = np.clip(np.floor((model.raw(_matrix(batch)) + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], ["bin", "y"])

    counted = check.select("x", "y").mapInArrow(bins, "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y"))
    grid = sorted((r.bin, r.n, r.y) for r in counted.collect())
    if not grid:
        grid = [(0, 1, 0.0), (BINS - 1, 1, 1.0)]
    at, n, y = map(np.array, zip(*grid, strict=True))
    model.edges = (at + 0.5) / BINS * 2 - 0.5
    model.values = pool(y.astype(float), n.astype(float))
    return model


def score(feats: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of features."""

    def run(batches):
        for batch in batches:
            found = model.score(_matrix(batch)) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = feats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = 200_000) -> DataFrame:
    """Scores of all documents by a model of the labelled ones; texts are read once."""
    feats = cut_lineage(features(docs))
    return score(feats, fit(feats, labels, sample))


def keep_good(docs: DataFrame, training: DataFrame, labels: DataFrame, sample: int = 200_000, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that a model of the labelled ``training`` documents accepts; every column stays."""
    wanted = training_labels(labels, sample).select(F.col("doc_id").alias("__wanted"))
    chosen = training.join(F.broadcast(wanted), F.col("doc_id").cast("long") == F.col("__wanted"), "left_semi")
    model = fit(features(chosen), labels, sample)
    names = docs.columns

    def run(batches):
        for batch in slices(batches):
            x = np.array([statistics(t) for t in batch.column(0).to_pylist()]).reshape(-1, FEATURES)
            good = pa.array(model.score(x) >= threshold, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(1)], ["row"]).filter(good)

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    kept = rows.mapInArrow(run, rows.select("row").schema)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in names])
