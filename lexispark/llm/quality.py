"""A quality classifier: a convolutional network over bytes, in numpy.

A text is cut into overlapping chunks that cover it whole. A filter of width
`WIDTH` is, over bytes, a table of 256 weights for each of its places, so a
convolution is `WIDTH` gathers and sums. A rectifier follows, the maximum of
each filter over a chunk, and, over the chunks of a document, both the largest
and the mean of those maxima; a logistic layer makes one probability of them.

The network learns on the driver from a bounded sample of labelled rows that
are not held out, by Adam, from every chunk of each; scoring is one pass of
the executors over all texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import columns, each, held_out, lean, table

FILTERS = 8
WIDTH = 4
#: Bytes of a chunk; chunks overlap by WIDTH - 1, so that every window of WIDTH bytes lies in one.
CHUNK = 512
#: Learning reads this many labelled documents at most, each of them whole,
TRAIN_DOCS = 2_000
#: and of those, in the order of their hashes, as many as have this many bytes together.
TRAIN_BYTES = 64 << 20
EPOCHS = 12
THRESHOLD = 0.3
#: Bytes scored at once, also in learning.
STEP = CHUNK * 512


def chunked(data: np.ndarray) -> np.ndarray:
    """Rows of CHUNK + WIDTH - 1 bytes that together cover data; the last is filled up with zeros."""
    rows = max(1, -(-(len(data) - WIDTH + 1) // CHUNK))
    full = np.zeros(rows * CHUNK + WIDTH - 1, np.uint8)
    full[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(full, CHUNK + WIDTH - 1)[::CHUNK]


@dataclass
class Network:
    """conv: (WIDTH, 256, FILTERS) weights, bias of filters, and the logistic layer over 2 * FILTERS features."""

    conv: np.ndarray
    bias: np.ndarray
    top: np.ndarray
    top_bias: float

    def maxima(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's maximum over each chunk, and where it is."""
        total = self.conv[0][rows[:, :CHUNK]]
        for k in range(1, WIDTH):
            total += self.conv[k][rows[:, k : CHUNK + k]]
        at = total.argmax(axis=1)
        return np.take_along_axis(total, at[:, None, :], axis=1)[:, 0, :], at

    def chunk_maxima(self, rows: np.ndarray) -> np.ndarray:
        total = self.conv[0].take(rows[:, :CHUNK], axis=0)
        for k in range(1, WIDTH):
            total += self.conv[k].take(rows[:, k : CHUNK + k], axis=0)
        return total.max(axis=1)

    def features(self, data: np.ndarray) -> np.ndarray:
        most, total, count = np.full(FILTERS, 0.0), np.zeros(FILTERS), 0
        for at in range(0, max(1, len(data) - WIDTH + 1), STEP):
            peaks = np.maximum(self.chunk_maxima(chunked(data[at : at + STEP + WIDTH - 1])) + self.bias, 0)
            most = np.maximum(most, peaks.max(axis=0))
            total += peaks.sum(axis=0, dtype=np.float64)
            count += len(peaks)
        return np.concatenate([most, total / count])

    def score(self, text: str | None) -> float:
        """The probability that a text is of good quality; null counts as empty."""
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        z = float(self.features(data) @ self.top) + self.top_bias
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def gradient(net: Network, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted mean log loss over texts, given as their chunks, by each parameter."""
    sizes = np.array(list(map(len, texts)))
    stack = np.concatenate(texts)
    doc = np.repeat(np.arange(len(texts)), sizes)
    starts = np.cumsum(sizes) - sizes
    found = [net.maxima(stack[k : k + STEP // CHUNK]) for k in range(0, len(stack), STEP // CHUNK)]
    raw, at = (np.concatenate(x) for x in zip(*found, strict=True))
    peaks = np.maximum(raw + net.bias, 0)
    lead = np.array([peaks[b : b + n].argmax(axis=0) + b for b, n in zip(starts, sizes, strict=True)])  # the chunk of each text's largest maximum
    lane = np.arange(FILTERS)
    average = np.add.reduceat(peaks, starts, axis=0) / sizes[:, None]
    feats = np.concatenate([peaks[lead, lane], average], axis=1)
    p = 1 / (1 + np.exp(-np.clip(feats @ net.top + net.top_bias, -60, 60)))
    dz = (p - labels) * weight / len(texts)
    dfeat = dz[:, None] * net.top[None, :]
    # that chunk takes the gradient of the largest maximum, every chunk its share of the mean
    dpeak = dfeat[doc, FILTERS:] / sizes[doc][:, None]
    np.add.at(dpeak, (lead, lane[None, :]), dfeat[:, :FILTERS])
    dpeak *= peaks > 0
    conv = np.zeros(net.conv.shape)
    for k in range(WIDTH):
        np.add.at(conv[k], (stack[np.arange(len(stack))[:, None], at + k], lane[None, :]), dpeak)
    return {"conv": conv, "bias": dpeak.sum(axis=0), "top": feats.T @ dz, "top_bias": np.array([dz.sum()])}


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Learn from texts (UTF-8) and labels (0 or 1); classes weigh alike however many rows each has."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, 2 * FILTERS), 0.0)
    share = float(np.mean(labels)) if len(labels) else 0.5
    if len(labels) == 0 or share in (0.0, 1.0):
        # nothing to tell apart: the score is the share of good labels, pulled to the middle
        p = (share * len(labels) + 1) / (len(labels) + 2)
        net.top[:] = 0
        net.top_bias = float(np.log(p / (1 - p)))
        return net
    rows = [chunked(np.frombuffer(text, np.uint8)) for text in texts]
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    params = {"conv": net.conv, "bias": net.bias, "top": net.top, "top_bias": np.zeros(1)}
    decay = {"conv": 1e-5, "bias": 0.0, "top": 1e-4, "top_bias": 0.0}
    mean = {k: np.zeros_like(v, np.float64) for k, v in params.items()}
    square = {k: np.zeros_like(v, np.float64) for k, v in params.items()}
    step = 0
    for epoch in range(epochs):
        for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 32)):
            step += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.001
            for name, g in gradient(net, [rows[k] for k in batch], labels[batch], weight[batch]).items():
                g = g + decay[name] * params[name]
                mean[name] += 0.1 * (g - mean[name])
                square[name] += 0.01 * (g * g - square[name])
                params[name] -= (rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8)).astype(params[name].dtype)
            net.top_bias = float(params["top_bias"][0])
    return net


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, n_bytes: int = TRAIN_BYTES) -> Network:
    """Learn labels.quality from texts of rows that are not held out; null labels, ids and texts are skipped.

    At most `limit` documents come to the driver, those of the least hashes of
    id and text, and of these as many as have `n_bytes` bytes together, each
    whole (one that alone has more is passed over). Rows that repeat both id
    and text are learned from once. Where an id has several labels the
    smallest counts.
    """
    known = columns(labels, "doc_id", "quality").where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = known.count()
    if rows > limit:  # some more than are wanted, so that the others' texts need not be looked at
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 1.5 * limit / rows)))
    texts = columns(docs, "doc_id", "text").where("text is not null")
    named = texts.join(F.broadcast(known), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("print"), F.octet_length("text").alias("n"), "text")
    order = F.xxhash64("doc_id", "print")
    few = named.select("doc_id", "quality", "print", "n").distinct().orderBy(order, "doc_id", "print").limit(limit).collect()
    chosen, left = [], n_bytes
    for row in few:
        if row.n <= left:
            chosen.append((row.doc_id, row["print"]))
            left -= row.n
    picked = docs.sparkSession.createDataFrame(chosen, "doc_id bigint, print bigint")
    found = named.join(F.broadcast(picked), ["doc_id", "print"]).dropDuplicates(["doc_id", "print"])
    got = found.select("doc_id", "print", "quality", F.col("text").cast("binary").alias("data")).toArrow().sort_by([("doc_id", "ascending"), ("print", "ascending")])
    return fit(got["data"].to_pylist(), got["quality"].to_numpy().astype(np.float64))


def scored(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row's whole text; no shuffle."""
    learned = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = learned.value
        for batch in batches:
            found = np.array([model.score(t) for t in each(batch.column(1))], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run, "quality"), "doc_id bigint, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text; others are ignored).

    Null and empty texts get the score that the network gives an empty text.
    Without usable labels all scores are 0.5. Rows that repeat an id are rows
    like any other; rows with a null id count as held out.
    """
    found = scored(docs, train(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
