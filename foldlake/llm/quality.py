"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Each text becomes a vector of hashed byte trigrams and of its shape (shares of letters, capitals, digits, symbols, lone
and repeated words, how few trigrams make up the text, each in soft bins). ``fit`` takes a bounded sample of labelled
rows (SAMPLE ids, the first by the hash of doc_id), weights terms by their rarity, and keeps the leading RANK singular
directions. The sample's latent vectors, SAMPLE x RANK floats whatever the corpus, are broadcast; each document's exact
cosines with all of them come from matrix products over blocks of documents, and the NEIGHBOURS nearest vote with their
labels, weighted by similarity.

Labels are learnt only from rows whose crc32(doc_id as text) mod 3 is not 1; label, lang, source and doc_id are not
inputs of the score. Defined cases: a null or empty text has a vector of its own shape and is scored like any other; a
null doc_id is not held out and teaches nothing; an id labelled twice counts by the mean of its labels; an id with
several texts teaches one of them; without labelled rows every score is 0.5. Similarities are compared in steps of 2^-16;
equal ones: the smaller id first. Repeated rows get equal scores; an empty table gives no rows. A text of any length is
read in blocks. Other columns pass through ``keep_good`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, map_texts, parts, table

HASHED, RANK, SAMPLE, NEIGHBOURS = 1024, 64, 4096, 15
#: Of a shape term against a common trigram.
SHAPE_WEIGHT = 2.0
KNOTS = np.array([0.0, 0.02, 0.08, 0.2, 0.45, 1.0])
SHAPES = 9
BLOCK = 1 << 20
#: Similarities are compared in steps; texts whose similarities are held at once.
STEPS, AT_ONCE = 1 << 16, 64
TERMS = HASHED + SHAPES * len(KNOTS)

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower case or beyond ASCII, 2 capital, 3 digit, 4 white space, 5 sentence marks, 6 symbols
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\r\x0b\x0c", ".,;:'\"?()-", "#*$%&|<>!@^~=+_/\\{}[]`"), 1):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[128:] = 1


def vector(text: str) -> np.ndarray:
    """TERMS floats: hashed trigram shares (square roots, unit length) and soft bins of the shapes (unit length)."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    grams, kinds = np.zeros(HASHED), np.zeros(7)
    for i in range(0, len(data), BLOCK):
        part = data[i : i + BLOCK + 2].astype(np.uint32)
        kinds += np.bincount(_CLASS[data[i : i + BLOCK]], minlength=7)
        if len(part) > 2:
            codes = (part[:-2] * np.uint32(0x9E3779B1) + part[1:-1] * np.uint32(0x85EBCA77) + part[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(22)
            grams += np.bincount(codes, minlength=HASHED)
    words = text.split()
    n = max(1, len(words))
    share = kinds / max(1, kinds.sum())
    letters = max(1.0, kinds[1] + kinds[2])
    total = max(1.0, grams.sum())
    again = sum(a == b for a, b in zip(words, words[1:])) / n
    shape = np.array([share[1], kinds[2] / letters, share[3], share[4], share[5], share[6], again, 1 - len(set(words)) / n, float(((grams / total) ** 2).sum())])
    out = np.zeros(TERMS, np.float32)
    out[:HASHED] = np.sqrt(grams / total)
    at = np.clip(np.searchsorted(KNOTS, shape, side="right") - 1, 0, len(KNOTS) - 2)
    part = np.clip((shape - KNOTS[at]) / (KNOTS[at + 1] - KNOTS[at]), 0, 1)
    rows = HASHED + np.arange(SHAPES) * len(KNOTS)
    out[rows + at], out[rows + at + 1] = (1 - part) / 3, part / 3
    return out


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    weights: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.weights) @ self.directions
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        k, n, out = min(NEIGHBOURS, len(self.labels)), len(self.labels), []
        for i in range(0, len(texts), AT_ONCE):
            cosines = self.latent(np.stack([vector(t) for t in texts[i : i + AT_ONCE]])) @ self.vectors.T
            steps = np.rint(cosines * STEPS).astype(np.int64)
            near = np.argpartition(np.arange(n) - steps * n, k - 1, axis=1)[:, :k]  # vectors go by id
            votes = np.maximum(np.take_along_axis(steps, near, 1) / STEPS, 1e-6)
            out.append((votes * self.labels[near]).sum(1) / votes.sum(1))
        return np.clip(np.concatenate(out) if out else np.zeros(0), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK) -> Model:
    """Learns from at most ``sample`` labelled ids outside the held-out third."""
    spark = docs.sparkSession
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
        .collect()
    )
    want = {r.doc_id: float(r.quality >= 0.5) for r in picked}
    none = Model(np.ones(TERMS, np.float32), np.zeros((TERMS, rank), np.float32), np.zeros((0, rank), np.float32), np.zeros(0))
    if not want:
        return none
    ids = spark.createDataFrame([(i,) for i in want], "doc_id bigint")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                if doc_id not in seen:
                    seen.add(doc_id)
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([vector(text.as_py() or "").tobytes()], pa.binary())], ["doc_id", "x"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most ``sample`` ids: the broadcast side has that bound
    rows = texts.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(once, "doc_id bigint, x binary").groupBy("doc_id").agg(F.min("x").alias("x")).collect()
    if not rows:
        return none
    rows.sort(key=lambda r: r.doc_id)
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows])
    weights = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.3
    weights[HASHED:] = SHAPE_WEIGHT
    x = x * (weights := weights.astype(np.float32))
    values, directions = np.linalg.eigh((x.T @ x).astype(np.float64))
    model = Model(weights, np.ascontiguousarray(directions[:, ::-1][:, :rank]).astype(np.float32), none.vectors, np.array([want[r.doc_id] for r in rows]))
    model.vectors = model.latent(x / weights)
    return model


SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def kernel(cols: list[list]) -> dict[str, list]:
        score = shared.value.score(cols[2]).tolist()
        return {"doc_id": cols[0], "held_out": cols[1], "score": score, "predicted": [int(s >= 0.5) for s in score]}

    return map_texts(docs.select("doc_id", held_out().alias("held_out"), "text"), ["doc_id", "held_out"], "text", kernel, SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose predicted label is 1, all columns as they were."""
    shared, at = docs.sparkSession.sparkContext.broadcast(fit(docs, labels)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, at):
            score = shared.value.score([t or "" for t in part.column(at).to_pylist()])
            yield part.filter(pa.array(score >= 0.5))

    return map_rows(docs, run)


def op7_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
