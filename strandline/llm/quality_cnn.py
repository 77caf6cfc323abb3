"""Quality classifier: a byte-level convolutional network in numpy.

The bytes of a whole text are cut into overlapping chunks that cover it to its last byte. Learned
filters slide over each chunk and are max-pooled within it; a hidden layer turns the pooled
filters into chunk features, and the largest and the mean of each feature over all chunks
give one probability.

The network learns from a bounded sample of labelled rows (`rows_per_class` for each label,
`chunks_per_text` chunks spread over each text in each pass). Scoring reads every byte of every
text. Null and empty texts are one chunk of padding and get a score like any other. With no
labelled row, or one class only, every score is 0.5. Repeated rows give repeated rows; columns
besides the key and the text are not read for scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.text_blocks import blocks, bounded_sample, held_out
from strandline.runtime import materialize, ship_package

CHUNK, HOP, WIDTH, STEP = 256, 192, 6, 2
EMBED, FILTERS, HIDDEN = 8, 24, 12
#: Share of the good training texts of which a pass sees a short excerpt, for short texts are rare.
SHORTENED = 0.3
PLACES = (CHUNK - WIDTH) // STEP + 1


def chunk_starts(size: int) -> np.ndarray:
    """Starts of the chunks of a text of `size` bytes; together they cover every byte."""
    return np.arange(max(1, -(-max(size - (CHUNK - HOP), 0) // HOP))) * HOP


def chunks_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of the texts of a block (padded with zero bytes), and the text of each."""
    starts = [chunk_starts(int(n)) for n in np.diff(ends)]
    owner = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
    begin = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    place = begin[:, None] + np.arange(CHUNK)
    inside = place < np.diff(ends)[owner][:, None]
    at = np.where(inside, place + ends[owner][:, None], 0)
    padded = np.append(data, np.uint8(0)) if len(data) == 0 else data
    return np.where(inside, padded[at], 0).astype(np.uint8), owner


class Network:
    """Weights, the training passes, and the tables for fast scoring."""

    def __init__(self, seed: int = 7):
        random = np.random.default_rng(seed)
        self.p = {
            "embed": random.normal(0, 0.5, (256, EMBED)),
            "filter": random.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)),
            "bias": np.zeros(FILTERS),
            "hidden": random.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)),
            "hidden_bias": np.zeros(HIDDEN),
            "out": random.normal(0, (2 * HIDDEN) ** -0.5, 2 * HIDDEN),
            "out_bias": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.tables: np.ndarray | None = None

    # training -----------------------------------------------------------------------------

    def gradients(self, chunks: np.ndarray, owner: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log-loss of a batch of whole texts."""
        p, n, texts = self.p, len(chunks), len(labels)
        windows = np.lib.stride_tricks.sliding_window_view(chunks, WIDTH, 1)[:, ::STEP]
        seen = p["embed"][windows].reshape(n, PLACES, WIDTH * EMBED)
        scores = seen @ p["filter"]
        top = scores.argmax(1)
        pooled = np.take_along_axis(scores, top[:, None, :], 1)[:, 0] + p["bias"]
        active = np.maximum(pooled, 0)
        hidden = np.tanh(active @ p["hidden"] + p["hidden_bias"])
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[starts, n])
        largest, mean = np.maximum.reduceat(hidden, starts), np.add.reduceat(hidden, starts) / sizes[:, None]
        both = np.concatenate([largest, mean], 1)
        error = (1 / (1 + np.exp(-(both @ p["out"] + p["out_bias"]))) - labels) * weights / texts
        back = error[:, None] * p["out"]
        winner = hidden == largest[owner]
        d_hidden = (winner * back[owner, :HIDDEN] + back[owner, HIDDEN:] / sizes[owner][:, None]) * (1 - hidden**2)
        d_pooled = (d_hidden @ p["hidden"].T) * (pooled > 0)
        taken = seen[np.arange(n)[:, None], top]  # chunk, filter, window
        d_taken = d_pooled[:, :, None] * p["filter"].T
        d_embed = np.zeros_like(p["embed"])
        byte = windows[np.arange(n)[:, None], top]
        np.add.at(d_embed, byte.reshape(-1), d_taken.reshape(-1, EMBED))
        return {
            "embed": d_embed,
            "filter": np.einsum("cfw,cf->wf", taken, d_pooled),
            "bias": d_pooled.sum(0),
            "hidden": active.T @ d_hidden,
            "hidden_bias": d_hidden.sum(0),
            "out": both.T @ error,
            "out_bias": error.sum(keepdims=True),
        }

    def fit(self, texts: list[bytes], labels: np.ndarray, chunks_per_text: int, passes: int, rate: float = 0.01, batch: int = 32) -> Network:
        random = np.random.default_rng(11)
        share = np.array([np.mean(labels == 0), np.mean(labels == 1)])
        weights = (0.5 / np.maximum(share, 1e-9))[labels.astype(int)]
        moment = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for turn in range(passes):
            for at in np.array_split(random.permutation(len(texts)), max(1, len(texts) // batch)):
                parts, owners = [], []
                for i, t in enumerate(at):
                    data = np.frombuffer(texts[t], np.uint8)
                    if labels[t] == 1 and random.random() < SHORTENED:  # good texts of any length are good
                        size = min(len(data), int(np.exp(random.uniform(np.log(6), np.log(200)))))
                        begin = random.integers(0, len(data) - size + 1)
                        data = data[begin : begin + size]
                    chunks, _ = chunks_of(data, np.array([0, len(data)]))
                    if len(chunks) > chunks_per_text:
                        chunks = chunks[np.sort(random.choice(len(chunks), chunks_per_text, replace=False))]
                    parts.append(chunks)
                    owners += [i] * len(chunks)
                step += 1
                slow = rate * (0.1 + 0.9 * (1 - turn / passes))
                for k, g in self.gradients(np.concatenate(parts), np.array(owners), labels[at], weights[at]).items():
                    moment[k] = 0.9 * moment[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - slow * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    # scoring ------------------------------------------------------------------------------

    def _tables(self) -> np.ndarray:
        """What each pair of neighbouring bytes adds to each filter at each of its pair positions."""
        if self.tables is None:
            by_place = self.p["filter"].reshape(WIDTH, EMBED, FILTERS)
            single = np.einsum("be,wef->wbf", self.p["embed"], by_place)
            self.tables = np.stack([(single[w][:, None] + single[w + 1][None]).reshape(65536, FILTERS) for w in range(0, WIDTH, 2)]).astype(np.float32)
        return self.tables

    def score(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Probabilities of the texts of a block; every byte is read."""
        p, tables = self.p, self._tables()
        chunks, owner = chunks_of(data, ends)
        hidden = np.empty((len(chunks), HIDDEN), np.float32)
        for at in range(0, len(chunks), 256):
            part = chunks[at : at + 256]
            pairs = part[:, ::2].astype(np.int32) * 256 + part[:, 1::2]
            scores = tables[0][pairs[:, :PLACES]]
            for i in range(1, WIDTH // 2):
                scores += tables[i][pairs[:, i : i + PLACES]]
            pooled = np.maximum(scores.max(1) + p["bias"], 0)
            hidden[at : at + 256] = np.tanh(pooled @ p["hidden"] + p["hidden_bias"])
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        both = np.concatenate([np.maximum.reduceat(hidden, starts), np.add.reduceat(hidden, starts) / np.diff(np.r_[starts, len(owner)])[:, None]], 1)
        return 1 / (1 + np.exp(-(both.astype(np.float64) @ p["out"] + p["out_bias"])))


def _excerpts(most: int):
    """A function over sampled rows: of texts beyond `most` bytes, chunks at even distances over the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column("t").to_pylist():
                if len(text) > most:
                    starts = np.linspace(0, len(text) - CHUNK, max(1, most // CHUNK)).astype(int).tolist()
                    text = b"".join(text[at : at + CHUNK] for at in starts)
                texts.append(text)
            yield batch.set_column(batch.schema.get_field_index("t"), "t", pa.array(texts, pa.binary()))

    return run


def train(labelled: DataFrame, text: str, label: str, key: str, rows_per_class: int = 600, chunks_per_text: int = 12, passes: int = 8, text_bytes: int = 1 << 16) -> Network | None:
    """A network from a bounded sample of labelled rows (null labels and texts are left out).

    The sample has `rows_per_class` rows of each label and `text_bytes` of each text at most: that much reaches the driver.
    """
    known = labelled.where(F.col(label).isin(0, 1) & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t"), F.col(label).cast("int").alias("y"))
    sample = bounded_sample(known, "y", "k", "t", rows_per_class).mapInArrow(_excerpts(text_bytes), "k " + known.schema["k"].dataType.simpleString() + ", t binary, y int").toPandas()
    sample = sample.sort_values(["k", "y", "t"])
    if sample["y"].nunique() < 2:
        return None
    return Network().fit([bytes(t) for t in sample["t"]], sample["y"].to_numpy(np.float32), chunks_per_text, passes)


def score(df: DataFrame, network: Network | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and score of every row of df, in one narrow pass."""
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for rows, data, ends in blocks(batches):
            scores = np.full(len(ends) - 1, 0.5) if network is None else network.score(data, ends)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(scores, pa.float64())], names=["k", "score"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, score double").withColumnRenamed("k", key)


def labelled_texts(documents: DataFrame, marks: DataFrame, rows_per_class: int) -> DataFrame:
    """(doc_id, text, quality) of about `rows_per_class` rows of each label, written.

    Rows are chosen by ids and digests alone, so the join with the labels moves no text; the texts of the chosen
    ones, whose number the parameter bounds, are then picked from one more read.
    """
    digest = F.xxhash64("doc_id", "text")
    known = documents.where("text IS NOT NULL").select("doc_id", digest.alias("body")).join(marks.where("quality IN (0, 1)"), F.col("doc_id") == F.col("labelled_id"))
    sample = bounded_sample(known.select("quality", "doc_id", "body"), "quality", "doc_id", "body", rows_per_class)
    chosen = materialize(sample.select("quality", F.col("doc_id").alias("chosen_id"), F.col("body").alias("chosen_body")), "quality-sample")
    met = documents.select("doc_id", "text").join(F.broadcast(chosen), (F.col("doc_id") == F.col("chosen_id")) & (digest == F.col("chosen_body")))
    return materialize(met.select("doc_id", "text", "quality"), "quality-texts")


def predict(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, rows_per_class: int = 600) -> DataFrame:
    """doc_id, held_out, score, predicted: learned on the labelled rows that are not held out."""
    ship_package(documents.sparkSession)
    marks = labels.select(F.col("doc_id").alias("labelled_id"), "quality").where(~held_out(F.col("labelled_id")))
    network = train(labelled_texts(documents, marks, rows_per_class), "text", "quality", "doc_id", rows_per_class)
    return score(documents, network).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
