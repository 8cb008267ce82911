"""Quality classifier: a ridge fit on random Fourier features of document statistics, calibrated.

The features approximate a Gaussian kernel. Each partition of the labelled rows adds up its share of the
normal equations; only these sums, whose size is fixed, reach the driver. Scores of a part of the labelled rows
that the ridge fit has not seen are made monotone in the share of good documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import common
from tidemark.session import stored

FEATURES = 300
RIDGE = 1e-4
THRESHOLD = 0.3

#: One labelled document in so many calibrates; raw scores count in steps of 1 / STEPS.
CALIBRATION = 4
STEPS = 1000

_CLASSES = [
    slice(65, 91), slice(97, 123), slice(48, 58), slice(128, 256), slice(9, 14), slice(32, 33),
    list(b".,"), list(b"!"), list(b"?;:'\"-()"), list(b"|"), list(b"#$%&*+/<=>@[\\]^_`{}~"),
]
STATISTICS = len(_CLASSES) + 12


def statistics(text: bytes | None) -> list[float]:
    """Shares of kinds of characters, lengths and repetition of the words and lines of a whole text."""
    text = text or b""
    n = max(1, len(text))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = [counts[c].sum() / n for c in _CLASSES]
    p = counts[counts > 0] / n
    words = text.lower().split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    own = common.word_hashes(words)
    kinds = np.unique(own, return_counts=True)[1] if words else np.ones(1)
    lines = text.split(b"\n")
    return [
        *shares,
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
        np.log1p(len(words)),
        min(lengths.mean(), 50.0),
        min(lengths.std(), 50.0),
        float((lengths <= 3).mean()),
        len(kinds) / m,
        np.log(m / len(kinds)) / np.log(m + 1.0),
        kinds.max() / m,
        float((own[1:] == own[:-1]).mean()) if len(own) > 1 else 0.0,
        len(set(lines)) / len(lines),
        np.log1p(m / len(lines)),
        np.log1p(m / (1.0 + counts[46] + counts[33] + counts[63])),
    ]


@dataclass
class Model:
    """All that scoring needs; its size does not depend on the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray
    ridge: np.ndarray
    steps: np.ndarray
    shares: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.offsets
        return np.hstack([np.sqrt(2.0 / FEATURES) * np.cos(z), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.fourier(x) @ self.ridge, -0.5, 1.5) if len(x) else np.empty(0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The calibrated share; within a level the raw score keeps a thousandth of a say."""
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, self.steps, self.shares) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def _matrix(batch, name: str) -> np.ndarray:
    return batch[name].flatten().to_numpy().reshape(len(batch[name]), -1)


def _with_statistics(df: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and the statistics of ``text``."""

    def run(batches):
        for batch in batches:
            rows = [statistics(t) for t in common.as_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in keep), pa.array(rows, pa.list_(pa.float64()))], names=[*keep, "x"]
            )

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(*keep, "text").mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "x array<double>"]))


def _normal_equations(rows: DataFrame, model: Model) -> np.ndarray:
    """The sums of z z' and z y over all rows, added up by partition and then by row of the matrix."""

    def run(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                z = model.fourier(_matrix(batch, "x"))
                total += z.T @ np.hstack([z, batch["y"].to_numpy()[:, None]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(FEATURES + 1)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "sums"]
        )

    parts = rows.select("x", "y").mapInArrow(run, "i long, sums array<double>")
    added = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))
    got = added.select("i", vector_to_array("sums").alias("sums")).toArrow().sort_by("i")
    return np.array(got["sums"].to_pylist()).reshape(-1, FEATURES + 2)


def _calibration(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the raw score and the share of good documents there, never falling."""

    def run(batches):
        for batch in batches:
            raw = model.raw(_matrix(batch, "x")) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.round(raw * STEPS) / STEPS), batch["y"]], names=["raw", "y"])

    steps = (
        rows.select("x", "y").mapInArrow(run, "raw double, y double")
        .groupBy("raw").agg(F.avg("y").alias("share"), F.count(F.lit(1)).cast("double").alias("n"))
    )
    fit = IsotonicRegression(featuresCol="raw", labelCol="share", weightCol="n").fit(steps)
    return fit.boundaries.toArray(), fit.predictions.toArray()


def fit(docs: DataFrame, labels: DataFrame, bandwidth: float = 4.0, seed: int = 7) -> Model:
    """Learns from the rows of ``labels`` (doc_id, quality) whose document is in ``docs``.

    Rows without a doc_id or a label, and labels without a document, are passed over; repeated rows count each.
    With no labelled row every text scores 0.5, and with labels of one kind every text scores that kind.
    """
    y = labels.where("quality is not null").select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("y"))
    stats = _with_statistics(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text"), "doc_id")
    rows = stored(
        stats.join(y, "doc_id").select("x", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION)) == 0).alias("later")),
        "labelled-statistics",
    )
    rng = np.random.default_rng(seed)
    model = Model(
        mean=np.zeros(STATISTICS), scale=np.ones(STATISTICS),
        weights=rng.normal(0.0, 1.0 / bandwidth, (STATISTICS, FEATURES)),
        offsets=rng.uniform(0.0, 2 * np.pi, FEATURES),
        ridge=np.zeros(FEATURES + 1), steps=np.array([0.0]), shares=np.array([0.5]),
    )
    if rows.isEmpty():
        return model
    vector = array_to_vector("x")
    seen = rows.agg(
        F.avg("y").alias("share"),
        Summarizer.mean(vector).alias("mean"), Summarizer.std(vector).alias("std"),
        F.min(F.when(F.col("later"), F.col("y"))).alias("low"), F.max(F.when(F.col("later"), F.col("y"))).alias("high"),
    ).first()
    model.mean, model.scale = seen["mean"].toArray(), np.maximum(seen["std"].toArray(), 1e-6)
    model.shares = np.array([seen["share"]])
    if seen["share"] in (0.0, 1.0):
        return model
    apart = seen["low"] is not None and seen["low"] != seen["high"]
    sums = _normal_equations(rows.where(~F.col("later")) if apart else rows, model)
    gram, target = sums[:, :-1], sums[:, -1]
    penalty = RIDGE * max(1.0, gram[-1, -1]) * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-9
    model.ridge = np.linalg.solve(gram + penalty, target)
    model.steps, model.shares = _calibration(rows.where("later") if apart else rows, model)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (0 to 1, higher: label 1 likelier) added; a null text scores as an empty one.

    An empty table gives an empty table; a column called score is replaced.
    """

    def run(batches):
        for batch in batches:
            rows = [statistics(t) for t in common.as_bytes(batch["text"])]
            x = np.array(rows).reshape(-1, STATISTICS)
            yield pa.RecordBatch.from_arrays(
                [batch["rest"], batch["text"], pa.array(model.scores(x))], names=["rest", "text", "made"]
            )

    packed = docs.select(common.others(docs, "text"), "text")
    types = {f.name: f.dataType.simpleString() for f in packed.schema}
    scored = packed.mapInArrow(run, f"rest {types['rest']}, text string, made double")
    return scored.select(*common.restored(scored, docs, "text", score=F.col("made")))


def held_out():
    """Rows that no label is learnt from; a row without a doc_id has no label and is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def fit_known(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(docs, labels.where(~held_out()))


def op3_quality(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_known(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op3_quality": op3_quality}
ORACLES = {}
