"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each text becomes some twenty statistics (lengths, shares of character classes, repetition, entropy); a random Fourier map of
the standardised statistics approximates a Gaussian kernel. The normal equations are summed within partitions, added up and
solved; the raw scores are calibrated by an isotonic regression on training rows that the ridge fit did not use. All sums are
of integers (fixed point), so the result does not depend on their order.

The fit takes at most SAMPLE labelled rows, those of smallest hash; every document is scored.

Defined results: null text counts as empty; empty texts are scored like others. Null doc_ids are scored and never labelled. A doc_id with several labels has their mean;
null labels are ignored. Without labels every score is 0.5. Rows that repeat are scored alike. Other columns
are ignored, whatever their names. An empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import hash_bits, held_out, keep, span_hashes, table, word_spans

FOLDS, SAMPLE, FEATURES, RIDGE, CUT = 4, 200_000, 256, 1.0, 0.7
#: Fixed point of statistics and of Fourier features.
FIX = 1024
_CLASS = np.full(256, 4, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 white, 4 other sign, 5 sentence sign, 6 beyond ASCII
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b"", b".,;:!?'\"-")):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 6


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a whole text, in fixed point."""
    raw = (text or "").encode("utf-8", "replace")
    a = np.frombuffer(raw, np.uint8)
    n = max(1, len(a))
    counts = np.bincount(a, minlength=256)
    shares = np.bincount(_CLASS, weights=counts, minlength=7) / n
    p = counts[counts > 0] / n
    joined, begin, end = word_spans(text)
    w = max(1, len(begin))
    size = end - begin
    kinds, often = np.unique(span_hashes(joined, begin, end), return_counts=True) if len(begin) else (np.zeros(0), np.zeros(1))
    pairs = span_hashes(joined, begin[:-1], end[1:]) if len(begin) > 1 else np.zeros(0)
    last = np.frombuffer(joined, np.uint8)[end - 1] if len(begin) else np.zeros(0, np.uint8)
    lines = raw.split(b"\n")
    odd = sum(counts[list(b"#$%&*|<>{}[]@=_/\\~^")]) / n
    top = np.sort(often)[::-1]
    stats = [
        np.log1p(len(a)), np.log1p(len(begin)), size.mean() if len(size) else 0, size.std() if len(size) else 0, np.log1p(size.max(initial=0)), *shares, odd,
        -(p * np.log2(p)).sum(), len(kinds) / w, top[0] / w, top[:5].sum() / w, len(np.unique(pairs)) / max(1, len(pairs)), np.isin(last, list(b".!?")).sum() / w,
        (_CLASS[last] == 4).sum() / w, (size <= 3).sum() / w, np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(len(begin) / len(lines)), counts.max() / n,
    ]
    return np.rint(np.asarray(stats, np.float64) * FIX).astype(np.int64)


def _stats(batches):
    for batch in batches:
        rows = [statistics(x) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "x"])


def _matrix(x) -> np.ndarray:
    return np.stack(list(x)).astype(np.float64) / FIX


class Model:
    """Standardisation, Fourier map, ridge weights and calibration."""

    def __init__(self, mean: np.ndarray, std: np.ndarray):
        rng = np.random.Generator(np.random.PCG64(11))
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.standard_normal((len(mean), FEATURES)) / np.sqrt(len(mean))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.theta, self.at, self.to = np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5)

    def features(self, x: np.ndarray) -> np.ndarray:
        """Fixed-point Fourier features and a constant."""
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.concatenate([np.rint(np.cos(z @ self.w + self.b) * FIX), np.full((len(x), 1), float(FIX))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.theta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.to), 0, 1)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the centres of the pools and their means."""
    order = np.lexsort((label, score))
    pools: list[list[float]] = []
    for s, y in zip(score[order], label[order]):
        pools.append([y, 1.0, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            y2, n2, s2 = pools.pop()
            pools[-1] = [pools[-1][0] + y2, pools[-1][1] + n2, pools[-1][2] + s2]
    return np.array([s / n for _, n, s in pools]), np.array([y / n for y, n, _ in pools])


def _sums(model: Model):
    def run(batches):
        gram, right = 0, 0
        for pdf in batches:
            if len(pdf):
                phi = model.features(_matrix(pdf.x))
                gram, right = gram + phi.T @ phi, right + phi.T @ np.rint(pdf.y.to_numpy() * FIX)
        if not np.isscalar(gram):
            yield pd.DataFrame({"gram": [gram.tobytes()], "right": [right.tobytes()]})

    return run


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """(doc_id, x, y) -> a model, from at most about `sample` rows; None without rows."""
    rows = labelled.withColumn("bits", hash_bits(F.col("doc_id"), "quality:"))
    n = rows.count()
    if not n:
        return None
    rows = keep(rows.where(F.col("bits") < int(2**48 * min(1.0, sample / n))), "op7-sample") if n > sample else rows
    rows = rows.withColumn("part", F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 3)
    moments = rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("s"), F.sum(F.col("v").cast("decimal(38,0)") * F.col("v")).alias("q"), F.count("*").alias("n")).toPandas().sort_values("k")
    mean = moments.s.to_numpy(float) / moments.n / FIX
    model = Model(mean.to_numpy(), np.sqrt(np.maximum(0, moments.q.astype(float) / moments.n / FIX**2 - mean**2)).to_numpy())
    parts = rows.where("not part").select("x", "y").repartition(16).mapInPandas(_sums(model), "gram binary, right binary").collect()  # sixteen at most
    gram = sum((np.frombuffer(p["gram"]).reshape(FEATURES + 1, -1) for p in parts), np.zeros((FEATURES + 1, FEATURES + 1)))
    right = sum((np.frombuffer(p["right"]) for p in parts), np.zeros(FEATURES + 1))
    model.theta = np.linalg.solve(gram + RIDGE * FIX**2 * np.eye(FEATURES + 1), right)
    check = rows.select("x", "y", "part").toPandas()  # at most `sample` rows
    check = check[check.part] if check.part.any() else check
    at, to = isotonic(np.round(model.raw(_matrix(check.x)), 6), check.y.to_numpy(float))
    model.at, model.to = at, to
    return model


def _score(model: Model):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                s = model.score(_matrix(pdf.x))
                yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "held_out": pdf.held_out, "score": s})

    return run


def scores(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """(doc_id, text), (doc_id, quality) -> doc_id, held_out, score, predicted."""
    stats = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_stats, "doc_id long, x array<long>")
    stats = keep(stats.withColumn("held_out", held_out(F.col("doc_id"), FOLDS)), "op7-stats")
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    model = fit(stats.where("not held_out").join(marks, "doc_id").select("doc_id", "x", "y"))
    if model is None:
        scored = stats.select("doc_id", "held_out", F.lit(0.5).alias("score"))
    else:
        scored = stats.mapInPandas(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = None
