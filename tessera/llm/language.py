"""Language identification by averaged hashed subword embeddings.

A text's byte n-grams (2 to 4 bytes, inside and across words, letters only) hash to rows of an embedding
table; their mean goes through a linear softmax. Both layers are fitted by stochastic gradient
descent in numpy on a bounded sample. A temperature calibrates the scores, and a score below a
threshold found on rows set apart counts as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, col, held_out, learned_from, read_table

ORDERS = (2, 3, 4)
BUCKET_BITS = 15
#: Labelled documents of each language that a fit collects, about.
PER_LANGUAGE = 700
_WORK = 1 << 20
#: Bytes of a text whose n-grams are looked up together; longer texts are worked through in slices, which add up.
SLICE = 1 << 20

#: ASCII bytes that are no letters become spaces; capitals become small; bytes of longer characters stay.
_PLAIN = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def _bytes(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each place of data."""
    h = np.full(max(0, len(data) - n + 1), 0x811C9DC5 + n, np.uint32)
    for j in range(n):
        h = (h ^ data[j : len(data) - n + 1 + j]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKET_BITS)


@dataclass
class LanguageModel:
    """table: for each bucket, its embedding times the softmax weights. A model without languages rejects everything."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def _sliced(self, text: bytes) -> tuple[np.ndarray, int]:
        """The sum of a long text's n-gram rows, and their number."""
        raw, total, count = np.frombuffer(text, np.uint8), np.zeros(len(self.languages)), 0
        for lo in range(0, len(raw), SLICE):
            for n in ORDERS:
                ids = _grams(_PLAIN[raw[lo : lo + SLICE + n - 1]], n)
                total += self.table[ids].sum(0, dtype=np.float64)
                count += len(ids)
        return total, count

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Calibrated probabilities, one row a text. A text shorter than an n-gram has the bias alone for it."""
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for i, t in enumerate(texts):
            if len(t) > SLICE:
                total[i], count[i] = self._sliced(t)
        size = np.array([len(t) if len(t) <= SLICE else 0 for t in texts], np.int64)
        data = _PLAIN[np.frombuffer(b"".join(t for t in texts if len(t) <= SLICE), np.uint8)]
        ends = np.cumsum(size)
        starts = ends - size
        for n in ORDERS:
            some = np.flatnonzero(ends - starts >= n)
            if not len(some):
                continue
            rows = np.vstack([self.table[_grams(data, n)], np.zeros((1, len(self.languages)), np.float32)])
            at = np.ravel(np.column_stack([starts[some], ends[some] - n + 1]))
            total[some] += np.add.reduceat(rows, np.minimum(at, len(rows) - 1), axis=0, dtype=np.float64)[::2]
            count[some] += (ends - starts)[some] - n + 1
        z = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit_language(texts: list[str], labels: list[str], dims: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> LanguageModel:
    """Fits on whole texts and, so that short ones are known too, on two random windows of each. Without texts, a model without languages."""
    if not texts:
        return LanguageModel([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    order = rng.permutation(len(texts))
    apart = set(order[: len(order) // 8].tolist()) if len(order) >= 40 else set()
    items: list[tuple[np.ndarray, np.ndarray, int]] = []
    for i in order:
        if i in apart:
            continue
        b = _bytes(texts[i])
        spans = [b] + [b[(lo := int(rng.integers(0, max(1, len(b) - 20)))) : lo + int(rng.integers(20, 160))] for _ in range(2)]
        for s in spans:
            data = _PLAIN[np.frombuffer(s, np.uint8)]
            ids = np.concatenate([_grams(data, n) for n in ORDERS])
            if len(ids):
                at, n = np.unique(ids, return_counts=True)
                items.append((at, (n / n.sum()).astype(np.float32), int(y[i])))
    table = (rng.standard_normal((1 << BUCKET_BITS, dims)) * 0.1).astype(np.float32)
    weights, bias = (rng.standard_normal((dims, len(languages))) * 0.1).astype(np.float32), np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(items)):
            at, share, label = items[k]
            mean = share @ table[at]
            z = mean @ weights + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[label] -= 1
            back = weights @ g
            weights -= step * np.outer(mean, g)
            bias -= step * g * 0.1
            table[at] -= step * 20 * share[:, None] * back
    model = LanguageModel(languages, table @ weights, bias, 1.0, 0.0)
    if apart:
        test = sorted(apart)
        # Windows, too: whole texts alone would be too easy to calibrate on.
        spans = [_bytes(texts[i]) for i in test] + [_bytes(texts[i])[:120] for i in test]
        truth = np.tile(y[test], 2)
        log_p = np.log(np.maximum(model.scores(spans), 1e-12))
        loss = lambda t: -np.mean((log_p / t - np.log(np.exp(log_p / t).sum(1, keepdims=True)))[np.arange(len(truth)), truth])
        model.temperature = float(min(np.geomspace(0.02, 8, 80), key=loss))
        p = model.scores(spans)
        top, right = p.max(1), p.argmax(1) == truth
        rank = np.argsort(-top)
        good = np.flatnonzero(np.cumsum(right[rank]) / np.arange(1, len(rank) + 1) >= 0.99)
        model.least = float(top[rank[good[-1]]]) if len(good) else 1.0
    return model


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): one row for each row of docs, from the whole text.

    A null text, or one without a letter, is `und` with score 0 and rejected; so is everything under a model without
    languages. rejected: the calibrated score is below the model's threshold. Null ids and repeated rows pass through; an empty table gives no
    rows; other columns are not read.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                texts, size = [], 0
                while lo + len(texts) < batch.num_rows and (not texts or size < _WORK):
                    texts.append(_bytes(batch.column(3)[lo + len(texts)].as_py()))
                    size += len(texts[-1])
                known = np.asarray(batch.column(2).slice(lo, len(texts)))
                names, top = np.full(len(texts), "und", object), np.zeros(len(texts))
                if model.languages:
                    p = model.scores(texts)
                    names[known], top[known] = np.array(model.languages, object)[p.argmax(1)][known], p.max(1)[known]
                here = batch.slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays([here.column(0), here.column(1), pa.array(names, pa.string()), pa.array(top), pa.array(top < model.least)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])
                lo += len(texts)

    known = F.coalesce(col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("known")
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), known, col(text_col).alias("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def learn_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """A model from about per_language rows of each language, none of them held out. Null ids, languages and texts, and texts without a letter, are left out; of an empty table, a model without languages."""
    rows = docs.where(learned_from() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sample = sorted(bounded_sample(rows.select("doc_id", "text", "lang"), "lang", per_language)[0].collect(), key=lambda r: (r["doc_id"], r["text"]))
    return fit_language([r["text"] for r in sample], [r["lang"] for r in sample])


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, learn_languages(docs))
