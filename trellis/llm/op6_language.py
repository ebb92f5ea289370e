"""Language ID by hyperdimensional profiles.

Each letter (any script; everything else is one separator) has a random vector of DIM signs. Three letters in a row are bound into one
vector: the product of the first letter's vector permuted twice, the second's permuted once, and the third's. A text's vector is
the bundle (sum) of its n-gram vectors, a language's prototype the bundle of its training texts. A text gets the language of the
prototype with the largest cosine; the score is that cosine, at least 0.

Prototypes are sums of integers, so they are the same in any order; what reaches the driver is one vector a language.

Defined results: texts that are null or without a letter are `und` with score 0, and so is every text if nothing was learned. Null lang or text teaches
nothing. Rows with null doc_id are in training. Ties go to the language that sorts first. Rows that repeat count as often as they
occur. Other columns are ignored, whatever their names. An empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import held_out, table

DIM, FOLDS, UND = 512, 4, "und"
#: A worker keeps the vectors of so many n-grams; then it starts anew.
CACHE = 60_000
_ids = np.full(0x110000, -1, np.int32)
_letters: list[np.ndarray] = []
_rows: dict[int, int] = {}
_vectors = np.zeros((1024, DIM), np.int8)


def _letter(cp: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(1_000_003 + cp)).integers(0, 2, DIM, dtype=np.int8) * np.int8(2) - np.int8(1)


def _coded(text: str) -> np.ndarray:
    """The n-grams of a text as numbers, one for each place."""
    if not _letters:
        _letters.append(_letter(32))
    cps = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    ids = _ids[cps]
    if len(ids) and ids.min() < 0:
        for cp in np.unique(cps[ids < 0]).tolist():
            if chr(cp).isalpha():
                _ids[cp] = len(_letters)
                _letters.append(_letter(cp))
            else:
                _ids[cp] = 0
        ids = _ids[cps]
    ids = np.concatenate([[0], ids, [0]])
    ids = ids[np.concatenate([[True], (ids[1:] != 0) | (ids[:-1] != 0)])].astype(np.int64)
    return (ids[:-2] << 40) | (ids[1:-1] << 20) | ids[2:] if len(ids) > 2 else np.zeros(0, np.int64)


def _place(code: int) -> int:
    """Where the vector of an n-gram is kept."""
    global _vectors
    at = _rows.get(code)
    if at is None:
        at = _rows[code] = len(_rows)
        if at >= len(_vectors):
            _vectors = np.concatenate([_vectors, np.zeros_like(_vectors)])
        a, b, c = (_letters[code >> s & 0xFFFFF] for s in (40, 20, 0))
        _vectors[at] = np.roll(a, 2) * np.roll(b, 1) * c
    return at


def vector(text: str | None) -> np.ndarray | None:
    """The bundle of a text; None without a letter."""
    return _bundle(text)[0]


def _bundle(text: str | None) -> tuple[np.ndarray | None, int]:
    """The bundle of a text, and how many n-grams it has that differ."""
    codes = _coded(text) if text else ()
    if not len(codes):
        return None, 0
    if len(_rows) > CACHE:
        _rows.clear()
    kinds, counts = np.unique(codes, return_counts=True)
    out = np.zeros(DIM)
    for at in range(0, len(kinds), 4096):  # few at a time, for texts in scripts of many letters
        rows = [_place(c) for c in kinds[at : at + 4096].tolist()]
        exact = np.float32 if len(codes) < 2**23 else np.float64
        out += counts[at : at + 4096].astype(exact) @ _vectors[rows].astype(exact)
    return out, len(kinds)


def _bundles(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            v = vector(text)
            if v is not None:
                sums[lang] = sums.get(lang, 0) + v
    for lang, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM), pa.int32()), pa.array(s.astype(np.int64))], ["lang", "dim", "s"])


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(text, lang) -> languages in order, and their prototypes of length 1."""
    good = docs.where("lang is not null and text is not null").select("lang", "text")
    sums = good.mapInArrow(_bundles, "lang string, dim int, s long").groupBy("lang", "dim").agg(F.sum("s").alias("s")).toPandas()
    langs = sorted(sums.lang.unique())
    protos = np.zeros((len(langs), DIM))
    protos[[langs.index(x) for x in sums.lang], sums.dim] = sums.s
    return langs, protos / np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-300)


def _predict(langs: list[str], protos: np.ndarray):
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores, seconds, sizes = [], [], [], []
        for text in texts:
            v, kinds = _bundle(text) if langs else (None, 0)
            sizes.append(kinds)
            if v is None:
                names.append(UND)
                scores.append(0.0)
                seconds.append(None)
                continue
            cos = protos @ v / max(np.linalg.norm(v), 1e-300)
            at = int(cos.argmax())
            names.append(langs[at])
            scores.append(float(min(1.0, max(0.0, cos[at]))))
            seconds.append(float(np.delete(cos, at).max()) if len(langs) > 1 else None)
        return pd.DataFrame({"lang_pred": names, "score": scores, "second": pd.Series(seconds, dtype="float64"), "kinds": sizes})

    # Called nondeterministic so that no filter on its columns is pushed below it: that would run it twice, in a second Python worker a task.
    return F.pandas_udf(predict, "lang_pred string, score double, second double, kinds int").asNondeterministic()


def identify(docs: DataFrame, langs: list[str], protos: np.ndarray) -> DataFrame:
    """docs with a struct _lid of lang_pred, score, second (the cosine with the next language) and kinds (the number of different n-grams)."""
    return docs.withColumn("_lid", _predict(langs, protos)(F.col("text")))


def predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) -> doc_id, held_out, lang_pred, score, learned from the rows that are not held out."""
    mine = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id"), FOLDS).alias("held_out"))
    langs, protos = learn(mine.where("not held_out"))
    return identify(mine.select("doc_id", "held_out", "text"), langs, protos).select("doc_id", "held_out", "_lid.lang_pred", "_lid.score")


#: A text's class is the power of two of its number of different n-grams; beyond the last one they count as it.
CLASSES, MANY = 22, 6


def _class() -> Column:
    return F.least(F.lit(CLASSES - 1), F.floor(F.log2(F.greatest(F.lit(1), F.col("_lid.kinds"))))).cast("int")


def bars(train: DataFrame, langs: list[str], protos: np.ndarray, rows: int = 30, deviations: float = 5.0) -> list[float]:
    """For each class of texts the cosine below which a text is of no known language.

    A training text's cosine with its language shows what known texts reach, that with the next language what texts of a language not
    learned reach. The bar is so many standard deviations above the latter's mean, but at least as many below the former's, so known
    texts stay. A class with fewer training texts than `rows` takes the bar of the one before it. From 2^MANY different n-grams
    the bar is never below what vectors of a strange script reach by chance (three deviations)."""
    judged = identify(train.where("lang is not null and text is not null").select("text"), langs, protos).where(F.col("_lid.lang_pred") != UND)
    fixed = [F.rint(F.col(f"_lid.{x}") * 4096).cast("long").alias(x) for x in ("score", "second")]
    sums = judged.select(_class().alias("k"), *fixed).groupBy("k").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{name}") for c in ("score", "second") for name, f in (("s", F.sum), ("q", lambda x: F.sum(F.col(x) * F.col(x))))])
    have = {r.k: r for r in sums.collect()}  # one row a class

    def moments(row, c: str) -> tuple[float, float]:
        mean = row[f"{c}_s"] / row.n
        return mean / 4096, max(0.0, row[f"{c}_q"] / row.n - mean**2) ** 0.5 / 4096

    out: list[float] = []
    for k in range(CLASSES):
        bar = out[-1] if out else -1.0
        if k in have and have[k].n >= rows:
            mean, sd = moments(have[k], "score")
            bar = mean - deviations * sd
            if len(langs) > 1:
                mean, sd = moments(have[k], "second")
                bar = min(bar, mean + deviations * sd)
        out.append(max(bar, 3 / DIM**0.5) if k >= MANY else bar)
    return out


def accepted(docs: DataFrame) -> DataFrame:
    """The documents of a known language, all their columns. Rejected: `und`, and texts whose cosine is under the bar of their class."""
    train = docs.where(~held_out(F.col("doc_id"), FOLDS))
    langs, protos = learn(train)
    if not langs:
        return docs.where("false")
    least = F.get(F.array(*map(F.lit, bars(train, langs, protos))), _class())
    return identify(docs, langs, protos).where((F.col("_lid.lang_pred") != UND) & (F.col("_lid.score") >= least)).drop("_lid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(table(spark, sf_dir, "documents"))


SQL = None
