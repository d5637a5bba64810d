"""A quality classifier from compression.

Two zstandard dictionaries are trained, one from blocks of good and one from blocks of bad labelled texts. A text's blocks are
compressed with either; the difference of the sizes over their sum says which class explains the text better. A logistic
curve, fitted on labelled texts that no dictionary has seen, turns the difference over the whole text, its least and greatest
value in a block, and the size of the text compressed alone into the chance of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import texts

#: Bytes of a block and of a dictionary, and the level of compression.
BLOCK, DICTIONARY, LEVEL = 512, 65_536, 1
#: Bounds of the labelled sample: texts of each class for the dictionary, and again for the curve, and code points of such a text.
SAMPLE, SAMPLE_CHARS = 1000, 20_000
#: A score of this or more predicts label 1.
KEEP = 0.7


def _blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)] or [b""]


@dataclass
class Model:
    """Two dictionaries and a curve; small, and the same whatever the size of the corpus."""

    good: bytes
    bad: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.coders = model, []
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        for data in (model.good, model.bad):
            held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO)
            held.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(dict_data=held, **plain))
        self.alone = zstandard.ZstdCompressor(**plain)

    def features(self, data: bytes) -> tuple[float, float, float, float]:
        good, bad = self.coders
        sizes = [(len(good.compress(b)), len(bad.compress(b))) for b in _blocks(data)]
        each = [(b - g) / (b + g) for g, b in sizes]
        g, b = sum(x for x, _ in sizes), sum(y for _, y in sizes)
        return (b - g) / (b + g), min(each), max(each), len(self.alone.compress(data)) / (len(data) + 1)

    def scores(self, texts_: list[bytes]) -> np.ndarray:
        if not texts_:
            return np.zeros(0)
        x = (np.array([self.features(t) for t in texts_]) - self.model.mean) / self.model.spread
        return 1 / (1 + np.exp(-np.clip(x @ self.model.weights[:-1] + self.model.weights[-1], -50, 50)))


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted logistic regression by Newton steps, with a small penalty."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[(x - mean) / spread, np.ones(len(x))]
    beta = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -50, 50)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + 0.5 * np.eye(len(beta)), a.T @ (w * (y - p)) - 0.5 * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return mean, spread, beta


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learns from labelled rows that aren't held out: at most 2 * sample texts of each class, the same ones at each run, go to the driver.

    docs: doc_id, text; labels: doc_id, quality (0 or 1; others count as absent). None where a class has fewer than 16 texts.
    Shares of the classes come from all labels that may be used, so scores are chances in the labelled population. Of equal texts the one
    whose id comes first by hash counts, of a row labelled both ways the 0; two runs over the same rows give the same model.
    """
    usable = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~is_held_out(F.col("doc_id")))
    shares = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    # four times as many ids as texts of one use, as some are too long, have no text or one that is there already
    drawn = [usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * sample) for q in (0, 1)]
    chosen = F.broadcast(drawn[0].union(drawn[1]).groupBy("doc_id").agg(F.min("quality").alias("quality")))
    got = texts(docs).where((F.length("text") > 0) & (F.length("text") <= SAMPLE_CHARS)).join(chosen, "doc_id")
    by: dict[int, list[tuple[int, bytes]]] = {0: [], 1: []}
    for q in (0, 1):
        first = F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")).alias("first")
        for r in got.where(F.col("quality") == q).groupBy("text").agg(first).orderBy("first").limit(2 * sample).select("first.doc_id", "text").collect():
            by[q].append((r["doc_id"], r["text"].encode()))
    if min(map(len, by.values())) < 16:
        return None
    halves = {q: (rows[0::2], rows[1::2]) for q, rows in by.items()}
    dictionaries = {}
    for q, (first, _) in halves.items():
        blocks = [b for _, t in first for b in _blocks(t)]
        size = min(DICTIONARY, max(1024, sum(map(len, blocks)) // 8))
        try:
            dictionaries[q] = zstandard.train_dictionary(size, blocks, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too few texts for the trainer: they are the dictionary as they stand
            dictionaries[q] = b"".join(blocks)[-size:]
    model = Model(dictionaries[1], dictionaries[0], np.zeros(4), np.ones(4), np.zeros(5))
    scorer = model.scorer()
    rows = [(scorer.features(t), q) for q, (_, second) in halves.items() for _, t in second]
    x, y = np.array([f for f, _ in rows]), np.array([float(q) for _, q in rows])
    w = np.where(y == 1, shares[1] / (y == 1).sum(), shares[0] / (y == 0).sum())
    model.mean, model.spread, model.weights = _curve(x, y, w * len(y) / w.sum())
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score for each row, repeated rows and null ids too. Scores see the text alone, so equal texts have equal scores; null counts as
    empty, an empty table gives no rows, columns of other names stay behind. Without a model every score is 0.5."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            data = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores(data), pa.float64())], ["doc_id", "score"])

    rows = texts(docs)
    return rows.mapInArrow(each, "doc_id long, score double") if model else rows.select("doc_id", F.lit(0.5).alias("score"))


def filter_documents(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """The rows of docs, all columns, whose text scores `keep` or more; all of them without a model. Nothing is joined or shuffled.

    Repeated rows and equal texts stay or go together, a score of exactly `keep` stays, a null text counts as empty; columns of any
    names pass through, and an empty table gives no rows.
    """
    if model is None:
        return docs

    @F.pandas_udf("double")
    def chance(text):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(model.scorer().scores([t.encode() for t in text.fillna("")]))

    return docs.where(chance(docs["text"].cast("string")) >= keep)
