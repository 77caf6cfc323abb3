"""Language identification with interpolated Kneser-Ney character models.

One model of order 4 for each language is learned from a bounded sample of labelled rows
(`rows_per_language`, whole texts). Probabilities are kept in sorted arrays of n-gram hashes.
A text goes to the language of the lowest cross-entropy per character. A text that
stands closer to random letters than to its language is marked as rejected; both ends of that scale
are calibrated, on the sample and on seeded random letters. The score is the share of the language
among the learned ones, times how near the text stands to it on that scale: it falls towards 0
for texts of no learned language.

Null texts, empty ones and those without a letter: language `und`, score 0, rejected. Rows with a
null language are scored but not learned from. With no labelled row every text is `und`. Repeated
rows give repeated rows; columns besides the key, text and language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.text_blocks import blocks, bounded_sample, code_points, held_out
from strandline.runtime import ship_package

ORDER = 4
UNDETERMINED = "und"
#: A text this far from its language towards random letters is rejected.
REJECTED = 0.6
_START, _GAP = 1, 32
_LOWER: np.ndarray | None = None


def _lower_letters() -> np.ndarray:
    """For each code point its lower-case letter, or a gap where it is none."""
    global _LOWER
    if _LOWER is None:
        _LOWER = np.full(0x110000, _GAP, np.uint32)
        for point in range(0x110000):
            char = chr(point)
            if char.isalpha():
                low = char.lower()
                _LOWER[point] = ord(low) if len(low) == 1 else point
    return _LOWER


def symbols(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts of a block, the text each belongs to, and the number of letters of each text.

    Letters are lower-cased, runs of anything else are one gap, and start marks precede each text.
    """
    points, ends = code_points(data, ends)
    low, count = _lower_letters()[points], len(ends) - 1
    owner = np.repeat(np.arange(count), np.diff(ends))
    gap = low == _GAP
    keep = np.ones(len(low), bool)
    keep[1:] = ~(gap[1:] & gap[:-1] & (owner[1:] == owner[:-1]))
    letters = np.bincount(owner[~gap], minlength=count)
    low, owner = low[keep], owner[keep]
    # the start marks: ORDER - 1 before the first symbol of each text
    place = np.arange(len(low)) + (owner + 1) * (ORDER - 1)
    out = np.full(len(low) + count * (ORDER - 1), _START, np.uint32)
    out[place] = low
    owners = np.full(len(out), -1)
    owners[place] = owner
    return out, owners, letters


def gram_hash(grams: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of a matrix of code points."""
    out = np.full(len(grams), grams.shape[1], np.uint64)
    for column in range(grams.shape[1]):
        out = (out ^ grams[:, column].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class _Sorted:
    """A table keyed by sorted hashes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table, and whether the keys are there."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return at, (self.keys[at] == keys) if len(self.keys) else np.zeros(len(keys), bool)


class KneserNey:
    """One language: discounted shares of the grams and weights of the contexts, for each order."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.shares: list[_Sorted] = []
        self.weights: list[_Sorted] = []
        self.levels: list[np.ndarray] = []
        for order in range(ORDER, 0, -1):
            ones, twos = np.sum(counts == 1), np.sum(counts == 2)
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            contexts, group = np.unique(gram_hash(grams[:, :-1]), return_inverse=True)
            totals = np.bincount(group, counts)
            self.shares.insert(0, _Sorted(gram_hash(grams), np.maximum(counts - discount, 0) / totals[group]))
            self.weights.insert(0, _Sorted(contexts, discount * np.bincount(group) / totals))
            self.levels.insert(0, grams)
            if order > 1:  # lower orders count the different left neighbours
                keys, first, counts = np.unique(gram_hash(grams[:, 1:]), return_index=True, return_counts=True)
                grams = grams[first, 1:]
        self.floor = 1.0 / (len(self.levels[0]) + 64)

    def weight(self, contexts: np.ndarray, order: int) -> np.ndarray:
        at, there = self.weights[order - 1].find(gram_hash(contexts))
        return np.where(there, self.weights[order - 1].values[at], 1.0)

    def probability(self, grams: np.ndarray) -> np.ndarray:
        order = grams.shape[1]
        if not order:
            return np.full(len(grams), self.floor)
        at, there = self.shares[order - 1].find(gram_hash(grams))
        return np.where(there, self.shares[order - 1].values[at], 0.0) + self.weight(grams[:, :-1], order) * self.probability(grams[:, 1:])


class LanguageModels:
    """All languages side by side: one sorted hash array for each order, a column for each language."""

    def __init__(self, languages: list[str], models: list[KneserNey]):
        self.languages = languages
        self.grams, self.contexts = [], []
        for order in range(1, ORDER + 1):
            seen = _distinct(np.concatenate([m.levels[order - 1] for m in models]))
            self.grams.append(_Sorted(gram_hash(seen), -np.log(np.stack([m.probability(seen) for m in models], 1)).astype(np.float32)))
            heads = _distinct(seen[:, :-1])
            self.contexts.append(_Sorted(gram_hash(heads), -np.log(np.stack([m.weight(heads, order) for m in models], 1)).astype(np.float32)))
        self.floor = -np.log(np.array([m.floor for m in models], np.float32))
        self.usual = np.zeros(len(languages))
        self.spread = np.ones(len(languages))
        self.limit = np.inf

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Negative log-probabilities, a row for each gram and a column for each language."""
        order = grams.shape[1]
        if not order:
            return np.broadcast_to(self.floor, (len(grams), len(self.floor)))
        table = self.grams[order - 1]
        at, there = table.find(gram_hash(grams))
        out = table.values[at]
        lost = np.flatnonzero(~there)
        if len(lost):
            rest = grams[lost]
            heads = self.contexts[order - 1]
            at, known = heads.find(gram_hash(rest[:, :-1]))
            out[lost] = np.where(known[:, None], heads.values[at], 0) + self.costs(rest[:, 1:])
        return out

    def entropies(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text of a block: mean cost under each language, symbols scored, letters."""
        out, owners, letters = symbols(data, ends)
        total = np.zeros((len(letters), len(self.languages)))
        for at in range(ORDER - 1, len(out), 1 << 18):
            where = np.arange(at, min(len(out), at + (1 << 18)))
            where = where[owners[where] >= 0]
            if len(where):
                costs = self.costs(np.stack([out[where - back] for back in range(ORDER - 1, -1, -1)], 1))
                own = owners[where]
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                total[own[starts]] += np.add.reduceat(costs, starts, axis=0, dtype=np.float64)
        count = np.bincount(owners[owners >= 0], minlength=len(letters))
        return total / np.maximum(count, 1)[:, None], count, letters

    def excess(self, entropies: np.ndarray, best: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Where a text stands between its language (0) and random letters (1); short texts count less."""
        above = entropies[np.arange(len(best)), best] - self.usual[best]
        return above / self.spread[best] * count / (count + 20)


def _distinct(grams: np.ndarray) -> np.ndarray:
    return grams[np.unique(gram_hash(grams), return_index=True)[1]]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, text) to (language, code points of a gram, count), summed within a block and language."""
    for rows, data, ends in blocks(batches):
        out, owners, _ = symbols(data, ends)
        where = np.flatnonzero(owners >= 0)
        if not len(where):
            continue
        grams = np.stack([out[where - back] for back in range(ORDER - 1, -1, -1)], 1)
        names, language = np.unique(np.array(rows.column(0).to_pylist(), object).astype(str), return_inverse=True)
        language = language[owners[where]]
        keys = gram_hash(np.concatenate([language[:, None].astype(np.uint32), grams], 1))
        _, first, counts = np.unique(keys, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[language[first]], pa.string()), *[pa.array(grams[first, i].astype(np.int32)) for i in range(ORDER)], pa.array(counts, pa.int64())],
            names=["language", *[f"c{i}" for i in range(ORDER)], "n"],
        )


def train(df: DataFrame, text: str, language: str, key: str, rows_per_language: int = 400) -> LanguageModels | None:
    """Models of every language of df, from a bounded sample of its rows.

    Executors count the grams of the sample; the driver gets the counts, whose size follows
    `rows_per_language` and not the table.
    """
    known = df.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(language).alias("language"), F.col(text).alias("t"))
    sample = bounded_sample(known, "language", "k", "t", rows_per_language).select("language", "t")
    columns = [f"c{i}" for i in range(ORDER)]
    counted = sample.mapInArrow(_gram_counts, f"language string, {', '.join(f'{c} int' for c in columns)}, n long").groupBy("language", *columns).agg(F.sum("n").alias("n"))
    got = counted.toPandas()
    if got.empty:
        return None
    got = got.sort_values(["language", *columns])
    names = sorted(got["language"].unique())
    parts = [got[got["language"] == name] for name in names]
    single = [KneserNey(p[columns].to_numpy(np.uint32), p["n"].to_numpy(np.float64)) for p in parts]
    models = LanguageModels(names, single)
    _calibrate(models, sample, [m.levels[0] for m in single])
    return models


def _calibrate(models: LanguageModels, sample: DataFrame, alphabets: list[np.ndarray]) -> None:
    """Set each language's usual cross-entropy on the sample, and its distance to that of random letters."""
    shared = sample.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, ends in blocks(batches):
            entropies, count, letters = shared.value.entropies(data, ends)
            best, some = entropies.argmin(1), letters > 0
            yield pa.RecordBatch.from_arrays([pa.array(best[some]), pa.array(entropies.min(1)[some]), pa.array(count[some])], names=["best", "entropy", "n"])

    seen = sample.mapInArrow(measure, "best long, entropy double, n long").toPandas().sort_values(["best", "entropy", "n"])
    random = np.random.default_rng(13)
    for i, name in enumerate(models.languages):
        own = seen[seen["best"] == i]
        if len(own):
            models.usual[i] = np.average(own["entropy"], weights=own["n"])
        letters = [chr(c) for c in alphabets[i].ravel().tolist() if c > _GAP]
        noise = "".join(random.choice(letters or [name], 2000)).encode()
        costs, _, _ = models.entropies(np.frombuffer(noise, np.uint8), np.array([0, len(noise)]))
        models.spread[i] = max(0.5, float(costs[0].min()) - models.usual[i])
    models.limit = REJECTED
    shared.unpersist()


def identify(df: DataFrame, models: LanguageModels | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score (0 to 1), rejected, cross_entropy of every row of df."""
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for rows, data, ends in blocks(batches):
            size = len(ends) - 1
            names, score, rejected, lowest = [UNDETERMINED] * size, np.zeros(size), np.ones(size, bool), np.zeros(size)
            if models is not None:
                entropies, count, letters = models.entropies(data, ends)
                best, some = entropies.argmin(1), letters > 0
                lead = np.exp(-(entropies - entropies.min(1, keepdims=True)) * np.minimum(count, 20)[:, None])
                excess = models.excess(entropies, best, count)
                score = np.where(some, np.clip(1 - excess, 0, 1) / lead.sum(1), 0.0)
                rejected = ~some | (excess > models.limit)
                names = [models.languages[b] if s else UNDETERMINED for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                lowest = np.where(some, entropies.min(1), 0.0)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected), pa.array(lowest)], names=["k", "lang_pred", "score", "rejected", "cross_entropy"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, lang_pred string, score double, rejected boolean, cross_entropy double").withColumnRenamed("k", key)


def keep_identified(df: DataFrame, models: LanguageModels | None, text: str = "text") -> DataFrame:
    """The rows of df whose language is accepted, with all their columns."""
    spark = df.sparkSession
    ship_package(spark)
    shared, column = spark.sparkContext.broadcast(models), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for rows, data, ends in blocks(batches, column):
            keep = np.zeros(len(ends) - 1, bool)
            if models is not None:
                entropies, count, letters = models.entropies(data, ends)
                keep = (letters > 0) & ~(models.excess(entropies, entropies.argmin(1), count) > models.limit)
            yield rows.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)


def predict(documents: DataFrame, rows_per_language: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, cross_entropy: learned on the rows that are not held out."""
    ship_package(documents.sparkSession)
    models = train(documents.where(~held_out(F.col("doc_id"))), "text", "lang", "doc_id", rows_per_language)
    return identify(documents, models).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")
