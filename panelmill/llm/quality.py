"""Quality classifier: learned hashed word and character n-gram vectors, averaged per document, with a softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Multipliers of the rolling hash (fixed values).
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)
#: Code points in one block of a long text; memory stays bounded, sums go on.
BLOCK = 1 << 19


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17
    dim: int = 12
    grams: tuple[int, ...] = (3, 4)
    epochs: int = 6
    rate: float = 0.5
    #: Labelled rows the fit may use at most: those with the least hash of their id.
    sample_rows: int = 4000
    seed: int = 7


def _spread(h: np.ndarray, buckets: int, salt: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31)) ^ np.uint64(salt)) * MIX_B
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _features(points: np.ndarray, s: Settings) -> np.ndarray:
    """Buckets of every word, word pair and character n-gram of code points that start and end with a 0 (a border)."""
    border = points == 0
    if border.all():
        return np.zeros(0, np.int64)
    char = (points.astype(np.uint64) + np.uint64(1)) * MIX_A
    char ^= char >> np.uint64(29)
    found = []
    gram = char.copy()
    inner = np.zeros(len(points) + 1, np.int32)
    np.cumsum(border, out=inner[1:])
    for n in range(2, max(s.grams) + 1):
        gram = gram[:-1] * MIX_B + char[n - 1 :]
        if n in s.grams and len(gram):
            crossed = inner[n - 1 : n - 1 + len(gram)] - inner[1 : 1 + len(gram)]
            found.append(_spread(gram[crossed == 0], s.buckets, n))
    starts = np.flatnonzero(~border[1:] & border[:-1]) + 1
    offset = np.arange(len(points)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(points)]))
    power = np.cumprod(np.r_[np.uint64(1), np.full(int(offset.max()), MIX_B, np.uint64)])
    word = np.add.reduceat(np.where(border, np.uint64(0), char * power[offset]), starts)
    found.append(_spread(word, s.buckets, 101))
    # the difference of two neighbours' hashes: an immediate repetition is one feature whatever the word
    found.append(_spread(word[1:] - word[:-1], s.buckets, 102))
    return np.concatenate(found)


def _blocks(text: str) -> Iterator[np.ndarray]:
    """Code points of the lower-cased text, white space as 0, cut at white space into blocks (a longer word is cut)."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[(points == 32) | ((points >= 9) & (points <= 13)) | (points == 160)] = 0
    at = 0
    while at < len(points):
        end = min(at + BLOCK, len(points))
        if end < len(points):
            gaps = np.flatnonzero(points[at:end] == 0)
            end = at + int(gaps[-1]) + 1 if len(gaps) else end
        yield np.concatenate([np.zeros(1, np.uint32), points[at:end], np.zeros(1, np.uint32)])
        at = end


def featurize(text: str | None, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the whole text and their counts."""
    parts = [_features(p, s) for p in _blocks(text or "")]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.float64)
    ids, n = np.unique(np.concatenate(parts), return_counts=True)
    return ids, n.astype(np.float64)


@dataclass
class Model:
    """Two-class softmax over the averaged vectors. As averaging is linear, each bucket has one weight for scoring."""

    weight: np.ndarray
    bias: float
    settings: Settings

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for points in _blocks(text or ""):
            ids = _features(points, self.settings)
            total += float(self.weight[ids].sum(dtype=np.float64))
            n += len(ids)
        z = self.bias + (total / n if n else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))


#: A text's distinct buckets and the share each has of its features.
Features = tuple[np.ndarray, np.ndarray]


def fit(docs: list[Features], labels: list[int], s: Settings = Settings()) -> Model:
    """Stochastic gradient descent, one document a step, the rate falling to zero. No rows: a constant 0.5."""
    rng = np.random.default_rng(s.seed)
    table = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim))
    out = np.zeros((s.dim, 2))
    bias = np.zeros(2)
    steps, done = max(1, s.epochs * len(docs)), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(docs)):
            rate = s.rate * (1 - done / steps)
            done += 1
            ids, share = docs[i]
            mean = share @ table[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * p
            # a document's features each carry a small share; the step is scaled to what its mean moves
            table[ids] -= (rate * min(len(ids), 2000)) * np.outer(share, back)
    return Model(table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]), s)


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, s: Settings, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality") -> list[tuple[Features, int]]:
    """Features and label of at most sample_rows labelled rows that aren't held out, in the order of their ids.

    Ids whose labels contradict each other and null labels teach nothing; of several texts of one id the least does. Only
    sample_rows ids, those of the least hash, come to the driver, then their features: the buckets of a text, which the
    executors count; whole texts never come.
    """
    clean = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(
        F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("id"))
    clean = clean.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    order = F.xxhash64(F.col("id"), F.lit(s.seed))
    few = clean.orderBy(order, "id").limit(s.sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id")
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("id", "y", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [featurize(t.as_py(), s) for t in b.column(2)]
            packed = [zstandard.compress(np.concatenate([np.diff(ids, prepend=0), n]).astype("<i4").tobytes()) for ids, n in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["id", "y", "packed"])

    def unpack(packed: bytes) -> Features:
        ids, n = np.frombuffer(zstandard.decompress(packed), "<i4").reshape(2, -1)
        return np.cumsum(ids).astype(np.int32), (n / max(1, n.sum())).astype(np.float32)

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(count, f"id {kind}, y int, packed binary").collect()
    return [(unpack(r.packed), r.y) for r in sorted(found, key=lambda r: r.id)]


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """Adds the score (0 to 1, higher: label 1 likelier) and the prediction (1 from 0.5 on) to every row.

    Whole texts are scored, block by block. Null and empty texts, and texts of white space only, get the
    score of no features (the bias). Repeated rows get equal scores; ids don't matter. Other columns stay, whatever their names,
    but columns of the two names are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((model.weight.astype(np.float32), model.bias, model.settings))
    rest = docs.drop(score_col, predicted_col)
    schema = rest.select("*", F.lit(0.0).alias(score_col), F.lit(0).alias(predicted_col)).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for b in batches:
            scores = [own.score(t.as_py()) for t in b.column(text_col)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32())],
                                             names=[*b.schema.names, score_col, predicted_col])

    return rest.mapInArrow(work, schema)


def classify(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), label_col: str = "quality", score_col: str = "score",
             predicted_col: str = "predicted") -> DataFrame:
    """Fit on the labelled rows that aren't held out, score every document.

    Labels that are null, contradict each other or name no document teach nothing; without any that teach, all scores are 0.5.
    Rows are treated as by score_documents.
    """
    pairs = training_rows(docs, labels, s, label_col=label_col)
    return score_documents(docs, fit([t for t, _ in pairs], [y for _, y in pairs], s), "text", score_col, predicted_col)
