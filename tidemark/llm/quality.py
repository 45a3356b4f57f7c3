"""Quality of texts: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover it whole. Bytes become
vectors, learned filters slide over them, every filter's maximum in a chunk is kept, and
the chunks' maxima are averaged into one probability. Filters are two steps of ``STEP``
bytes wide, so a product over the steps serves both halves of every window.

The network is fitted on at most about ``fit_rows`` labelled texts, taken by hash, with
up to ``fit_chunks`` chunks spread over each; scoring reads every chunk of every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textbytes import parts, slices
from tidemark.session import ship_package

CHUNK, OVERLAP, STEP, DIM, FILTERS = 512, 64, 4, 8, 32
FIT_ROWS, FIT_CHUNKS, EPOCHS, BATCH = 3000, 4, 4, 64
PAD = 256  # fills the last chunk


def chunks_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin of every chunk of several texts, and the text it is of; an empty text has none."""
    size = np.diff(at)
    n = np.where(size > 0, np.maximum(1, -(-(size - OVERLAP) // (CHUNK - OVERLAP))), 0)
    text = np.repeat(np.arange(len(size)), n)
    number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return at[:-1][text] + number * (CHUNK - OVERLAP), text


def take(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes of chunks as rows of ``CHUNK``."""
    place = begins[:, None] + np.arange(CHUNK)
    out = raw[np.minimum(place, len(raw) - 1)].astype(np.int16)
    out[place >= ends[:, None]] = PAD
    return out


class Network:
    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.weights = {
            "bytes": normal(PAD + 1, DIM, scale=0.5), "filters": normal(2 * STEP * DIM, FILTERS, scale=0.12),
            "shift": np.zeros(FILTERS, np.float32), "out": normal(FILTERS, scale=0.1), "bias": np.zeros(1, np.float32),
        }
        self.weights["bytes"][PAD] = 0

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's maximum in each chunk, and the window where it is."""
        w, half = self.weights, STEP * DIM
        steps = w["bytes"][chunks].reshape(-1, half)
        both = steps @ np.concatenate([w["filters"][:half], w["filters"][half:]], axis=1)
        both = both.reshape(len(chunks), CHUNK // STEP, 2 * FILTERS)
        windows = both[:, :-1, :FILTERS] + both[:, 1:, FILTERS:]
        where = windows.argmax(1)
        top = np.take_along_axis(windows, where[:, None], 1)[:, 0] + w["shift"]
        return np.maximum(top, 0), where

    def logits(self, pooled: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros((n, FILTERS), np.float32)
        np.add.at(total, text, pooled)
        mean = total / np.maximum(np.bincount(text, minlength=n), 1)[:, None]
        return mean @ self.weights["out"] + self.weights["bias"], mean

    def gradients(self, chunks: np.ndarray, text: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.weights, len(labels)
        pooled, where = self.pooled(chunks)
        logit, mean = self.logits(pooled, text, n)
        error = ((1 / (1 + np.exp(-logit)) - labels) / n).astype(np.float32)
        each = (error / np.maximum(np.bincount(text, minlength=n), 1))[text]
        back = each[:, None] * w["out"] * (pooled > 0)
        place = where[:, :, None] * STEP + np.arange(2 * STEP)
        seen = chunks[np.arange(len(chunks))[:, None, None], place]
        windows = w["bytes"][seen].reshape(len(chunks), FILTERS, -1)
        to_bytes = np.zeros_like(w["bytes"])
        np.add.at(to_bytes, seen, (back[:, :, None] * w["filters"].T).reshape(*seen.shape, DIM))
        to_bytes[PAD] = 0
        return {"bytes": to_bytes, "filters": np.einsum("cf,cfd->df", back, windows), "shift": back.sum(0),
                "out": error @ mean, "bias": error.sum(keepdims=True)}

    def train(self, chunks: np.ndarray, text: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        first = np.searchsorted(text, np.arange(len(labels) + 1))
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, total = 0, epochs * -(-len(labels) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for lo in range(0, len(order), BATCH):
                own = order[lo : lo + BATCH]
                rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in own])
                of = np.repeat(np.arange(len(own)), first[own + 1] - first[own])
                step += 1
                now = rate * (1 - step / (total + 1))
                for k, g in self.gradients(chunks[rows], of, labels[own]).items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.01 * (g * g - square[k])
                    self.weights[k] -= now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probability for every text of a block."""
        begins, text = chunks_of(raw, at)
        pooled = [np.zeros((0, FILTERS), np.float32)]
        for lo in range(0, len(begins), 256):
            pooled.append(self.pooled(take(raw, begins[lo : lo + 256], at[1:][text[lo : lo + 256]]))[0])
        logit, _ = self.logits(np.concatenate(pooled), text, len(at) - 1)
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_chunks: int = FIT_CHUNKS) -> Network:
    """A network learned from ``labels (doc_id, label)``; without a labelled text its scores are all one half."""
    n = labels.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / F.lit(1 << 30)
    some = labels.where(draw < min(1.0, fit_rows / max(n, 1))).limit(2 * fit_rows)  # the bound that makes the broadcast safe

    def cut(batches):
        for batch in batches:
            raw, at = parts(batch.column(2))
            rows = []
            for i, (doc, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                begins, _ = chunks_of(raw, at[i : i + 2])
                if len(begins):
                    begins = begins[np.unique(np.linspace(0, len(begins) - 1, fit_chunks).round().astype(int))]
                    rows.append((doc, label, take(raw, begins, np.full(len(begins), at[i + 1])).tobytes()))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["doc_id", "label", "chunks"])

    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id").select("doc_id", "label", "text")
    got = rows.mapInArrow(cut, "doc_id long, label long, chunks binary").toPandas().sort_values(["doc_id", "label"])
    network = Network()
    if len(got):
        each = [np.frombuffer(x, np.int16).reshape(-1, CHUNK) for x in got["chunks"]]
        text = np.repeat(np.arange(len(each)), [len(x) for x in each])
        y = got["label"].to_numpy(np.float32)
        rate = np.clip(y.mean(), 0.02, 0.98)
        network.weights["bias"][:] = np.log(rate / (1 - rate))
        network.train(np.concatenate(each), text, y)
    else:
        network.weights["out"][:] = 0
    return network


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = FIT_ROWS,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)`` of every row of ``docs``; ``labels`` holds ``doc_id`` and a ``label`` of 0 or 1.

    Null texts score as empty ones: by the bias alone. Labels of documents that are not there
    and null labels teach nothing; repeated ones count each. Other columns are ignored.
    """
    rows, model = _model(docs, labels, fit_rows, id_col, text_col)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_rate(batch.column(1), model.value))], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = FIT_ROWS,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is ``threshold`` or more.

    Each row is decided where it is read, by its own text: null and repeated ids do not matter.
    """
    _, model = _model(docs, labels, fit_rows, id_col, text_col)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        return pa.array(_rate(texts, model.value) >= threshold)

    return docs.where(good(F.col(text_col)))


def _model(docs: DataFrame, labels: DataFrame, fit_rows: int, id_col: str, text_col: str):
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    labels = labels.where("label is not null").select(F.col("doc_id").cast("long"), F.col("label").cast("long"))
    return rows, docs.sparkSession.sparkContext.broadcast(fit(rows, labels, fit_rows).weights)


def _rate(texts: pa.Array, weights: dict[str, np.ndarray]) -> np.ndarray:
    network = Network()
    network.weights = weights
    raw, at = parts(texts)
    found = [network.scores(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]) for lo, hi in slices(at)]
    return np.concatenate([np.zeros(0), *found])
