"""Quality by compression.

Two zstandard dictionaries are trained, on pieces of text labelled good and of text labelled bad. A document is
compressed in pieces with each; by how many bytes a byte of text the good dictionary does better is its raw score. A
logistic curve of that difference alone, fitted on labelled rows that trained no dictionary, makes it a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, col, giving_back, held_out, learned_from, read_table

#: Labelled documents of each class that a fit collects, about.
PER_CLASS = 2500
#: Bytes of a dictionary; pieces of each labelled text that train it.
DICTIONARY, SAMPLES = 112 << 10, 8
#: Text is compressed in pieces of so many bytes: a longer one would teach the compressor its own text.
PIECE = 1024
LEVEL = 3
#: Differences beyond this many standard deviations bend the curve no more.
FAR = 4.0


@dataclass
class QualityModel:
    """Dictionaries (empty: none) and the curve: bias + weight * clipped (difference - centre) / scale."""

    good: bytes
    bad: bytes
    bias: float = 0.0
    weight: float = 0.0
    centre: float = 0.0
    scale: float = 1.0

    def probabilities(self, differences: np.ndarray) -> np.ndarray:
        z = np.clip((np.asarray(differences, float) - self.centre) / self.scale, -FAR, FAR)
        return 1 / (1 + np.exp(-(self.bias + self.weight * z)))


class Measure:
    """Compressed sizes of a text's pieces under a model's two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        def made(content: bytes):
            options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            if not content:
                return zstandard.ZstdCompressor(**options)
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=d, **options)

        self.both = [made(c).compress for c in (good, bad)]

    def difference(self, text: str | None) -> float:
        """(bytes under the bad dictionary - bytes under the good one) / bytes of the text; 0 for a text without bytes."""
        b = (text or "").encode("utf-8", "surrogatepass")
        by_good, by_bad = self.both
        saved = 0
        for i in range(0, len(b), PIECE):
            piece = b[i : i + PIECE]
            saved += len(by_bad(piece)) - len(by_good(piece))
        return saved / max(1, len(b))


def _dictionary(texts: list[str], rng: np.random.Generator) -> bytes:
    """A dictionary trained on random pieces of the texts; raw pieces if they are too few to train on, empty without text."""
    import zstandard

    pieces = []
    for t in texts:
        b = t.encode("utf-8", "surrogatepass")
        for _ in range(SAMPLES):
            lo = int(rng.integers(0, max(1, len(b) - PIECE + 1)))
            if len(b) >= 8:
                pieces.append(b[lo : lo + PIECE])
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, pieces)) // 4)), pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:DICTIONARY]


def fit_quality(texts: list[str], labels: list[int], counts: dict[int, int] | None = None, seed: int = 5) -> QualityModel:
    """texts and their labels, 1 good and 0 bad: half train the dictionaries, half fit the curve.

    counts: how many rows each label has where the texts were sampled from; the curve is fitted to these shares. Without both
    labels, all scores are the share of 1 among them (1/2 if there are none).
    """
    rng = np.random.default_rng(seed)
    if len(set(labels)) < 2:
        n, good = len(labels), sum(labels)
        return QualityModel(b"", b"", bias=float(np.log((good + 1) / (n - good + 1))))
    order = rng.permutation(len(texts))
    build, fit = order[: len(order) // 2], order[len(order) // 2 :]
    if len(order) < 40:
        build = fit = order
    good, bad = (_dictionary([texts[i] for i in build if labels[i] == c], rng) for c in (1, 0))
    measure = Measure(good, bad)
    d, y = np.array([measure.difference(texts[i]) for i in fit]), np.array([labels[i] for i in fit], float)
    model = QualityModel(good, bad, centre=float(np.median(d)), scale=float(d.std()) + 1e-9)
    x = np.column_stack([np.ones(len(d)), np.clip((d - model.centre) / model.scale, -FAR, FAR)])
    n = np.ones(len(y))
    if counts:
        n = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
        n *= len(y) / n.sum()
    w, ridge = np.zeros(2), np.eye(2) * 1e-2
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ w)
    model.bias, model.weight = map(float, w)
    return model


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, saving): one row for each row of docs, from the whole text; saving is the raw difference.

    A null text counts as empty; a text without bytes has a difference of 0. Null ids and
    repeated rows pass through; an empty table gives no rows; other columns are not read.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(model.good, model.bad)
        for batch in batches:
            if not batch.num_rows:
                continue
            d = np.array([measure.difference(t.as_py()) for t in batch.column(2)])
            p = model.probabilities(d)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(d)], ["doc_id", "held_out", "score", "predicted", "saving"])

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), col(text_col).alias("text"))
    return rows.mapInArrow(giving_back(predict), "doc_id long, held_out boolean, score double, predicted int, saving double")


def learn_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    """A model from about per_class rows of each class, none held out. An id with several labels counts as good if one of them is.

    Labels are read first, and only the sampled ids' texts: the ids, twice per_class in number, are broadcast. Labels other
    than 0 and 1, null ids and null texts are left out.
    """
    known = labels.where(learned_from() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen, counts = bounded_sample(known, "quality", per_class)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return fit_quality([r["text"] for r in rows], [r["quality"] for r in rows], counts)


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject: predicted is 1. Columns as in docs, whatever their names.

    A null text is scored as empty; repeated rows stay or go together; an id with several labels counts as good if one of them is;
    an empty table gives no rows.
    """
    model = learn_quality(docs, labels)
    plain = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(model.good, model.bad)
        for batch in batches:
            if batch.num_rows:
                d = [measure.difference(t.as_py()) for t in batch.column(at)]
                yield batch.filter(pa.array(model.probabilities(np.array(d)) >= 0.5))

    renamed = docs.toDF(*plain)
    return renamed.mapInArrow(giving_back(keep), renamed.schema).toDF(*docs.columns)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_quality(docs, learn_quality(docs, read_table(spark, sf_dir, "labels")))
