"""Secret scan: fixed patterns, and character Markov models compared by log-likelihood ratio.

Patterns find assignments, access keys and long hexadecimal runs. Beside them every run of 16 or
more identifier characters outside these spans is scored under two character Markov models, one of
random strings and one of ordinary identifiers, and is a secret where the log-likelihood ratio for each
character is beyond the limit; of other runs the parts between separators are scored by themselves.
The labelled samples are: random, seeded draws over the usual
key alphabets and the spans that the patterns find; ordinary, made identifiers in the usual styles
and the other words of a bounded sample of the documents (`sample_rows`). The limit is set by further
labelled strings, the ordinary ones of other words. Runs of digits alone count as ordinary.

Offsets count code points, the end is exclusive. Null and empty texts have no spans. Repeated
rows give repeated rows; an empty table trains on the random strings alone and gives an empty
table; columns besides the key and the text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.text_blocks import blocks, distinct_rows, sample_share
from strandline.runtime import ship_package

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24, "markov": 16}
PLACEHOLDER = "[SECRET]"
Span = tuple[int, int, int]  # start, kind, end


def _mask(allowed: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(allowed)] = True
    return out


_DIGITS, _LOWER, _UPPER = b"0123456789", bytes(range(97, 123)), bytes(range(65, 91))
_HEX, _SEPARATOR = _mask(_DIGITS + b"abcdef"), _mask(b":=")
_WORD, _PART_ENDS = _mask(_DIGITS + _LOWER + _UPPER + b"+/_=-"), _mask(b"/=_-")
#: Symbols of the Markov models: letters, digits and a few signs; 0 is the edge of a word.
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(_DIGITS + _LOWER + _UPPER + b"+/_=-")] = np.arange(1, 68)
STATES = 68
#: How often each made identifier counts beside the words of the sample.
WEIGHT = 3.0


def runs(inside: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes of at least `least`, none across two texts."""
    padded = np.zeros(len(inside) + 2, np.int8)
    padded[1:-1] = inside
    edge = np.diff(padded)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = ends[1:-1]
    cut = np.unique(inner[(np.searchsorted(stop, inner, side="right") < len(stop))]) if len(stop) else inner[:0]
    if len(cut):  # a run over the seam of two texts is two runs
        at = np.searchsorted(stop, cut, side="right")
        crossed = cut[(start[np.minimum(at, len(start) - 1)] < cut)]
        if len(crossed):
            start, stop = np.sort(np.append(start, crossed)), np.sort(np.append(stop, crossed))
    long = stop - start >= least
    return start[long], stop[long]


class MarkovPair:
    """Log-likelihood ratios of character transitions: random strings against ordinary identifiers."""

    def __init__(self, random_counts: np.ndarray, ordinary_counts: np.ndarray):
        self.ratio = self._logs(random_counts) - self._logs(ordinary_counts)
        self.limit = 0.5

    @staticmethod
    def _logs(counts: np.ndarray) -> np.ndarray:
        smooth = counts + 0.2 + 2.0 * counts.sum(0, keepdims=True) / max(1.0, counts.sum())
        return np.log(smooth / smooth.sum(1, keepdims=True))

    def mean_ratios(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio per character of each span."""
        if not len(start):
            return np.zeros(0)
        sizes = stop - start
        first = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) + np.repeat(start - first, sizes)
        now = _SYMBOL[data[place]]
        before = np.r_[0, now[:-1]]
        before[first] = 0
        return np.add.reduceat(self.ratio[before, now], first) / sizes


def transitions(words: list[bytes]) -> np.ndarray:
    """Counts of the symbol pairs of some words."""
    out = np.zeros((STATES, STATES))
    joined = _SYMBOL[np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)]
    np.add.at(out, (joined[:-1], joined[1:]), 1)
    return out


def random_samples(count: int = 3000, seed: int = 5) -> list[bytes]:
    """Seeded draws over the alphabets keys are usually written in."""
    random = np.random.default_rng(seed)
    alphabets = (_DIGITS + b"abcdef", _DIGITS + _LOWER, _DIGITS + _UPPER, _DIGITS + _LOWER + _UPPER, _DIGITS + _LOWER + _UPPER + b"+/", _DIGITS + _LOWER + _UPPER + b"-_")
    return [bytes(random.choice(list(alphabets[i % len(alphabets)]), random.integers(16, 65)).astype(np.uint8)) for i in range(count)]


#: Words that names in programs are made of, dealt over training, calibration and testing by their place.
PARTS = """
abstract access account action active adapter address admin after alert alias align array async attribute audio author
backup balance batch before binary block boolean border branch bucket buffer build button bytes cache callback cancel
category channel char check child class clean client clock cluster code collection color column command commit config
connection constant container content context control cookie counter create currency current cursor custom daemon data
database date debug decode default delete device dialog digest directory disk document domain driver duration element
email empty enable encode endpoint engine entity entry error event exception execute expression factory failed feature
field file filter first flag folder format frame function gateway generic global group handler hash header height helper
history host http image import index inner input insert instance integer interface internal invoice item iterator java
json kernel keyboard label language layer length level library limit listener local lock logger manager mapping matrix
maximum member memory message metadata method minimum mobile model module monitor network node notification number object
offset operation option order output package page parameter parent parser password path payment permission pixel player
""".split()
#: Ways of writing a name.
STYLES = ("snake", "constant", "camel", "pascal", "kebab", "path", "plain", "numbered", "dated")
ACRONYMS = "API CSS DNS GUI HTML HTTP ID IO JSON PDF SQL TCP UI URL UTC UUID XML".split()


def identifier_samples(count: int = 4000, seed: int = 6, part: str = "train") -> list[bytes]:
    """Seeded identifiers in the usual styles; for training, calibration ("limit") and testing ("test") of different words."""
    random = np.random.default_rng(seed)
    words = [w for i, w in enumerate(PARTS) if {4: "test", 7: "limit"}.get(i % 9, "train") == part]
    out = []
    for i in range(count):
        picked = [words[j] for j in random.integers(0, len(words), random.integers(2, 6))]
        style = STYLES[i % len(STYLES)]
        if style in ("camel", "pascal"):
            cased = [ACRONYMS[random.integers(0, len(ACRONYMS))] if random.random() < 0.15 else w.capitalize() for w in picked]
            name = "".join([picked[0], *cased[1:]] if style == "camel" else cased)
        elif style == "numbered":
            name = "_".join(picked) + str(random.integers(1, 1000))
        elif style == "dated":
            name = f"{picked[0]}-{random.integers(1990, 2040)}-{random.integers(1, 13):02}-{random.integers(1, 29):02}" + f"T{random.integers(0, 24):02}-{random.integers(0, 60):02}-{random.integers(0, 60):02}" * (i % 2)
        else:
            name = {"snake": "_", "constant": "_", "kebab": "-", "path": "/", "plain": ""}[style].join(picked)
        out.append((name.upper() if style == "constant" else name).encode())
    return out


def mean_scores(models: MarkovPair, words: list[bytes]) -> np.ndarray:
    sizes = np.array([len(w) for w in words])
    stop = np.cumsum(sizes)
    return models.mean_ratios(np.frombuffer(b"".join(words), np.uint8), stop - sizes, stop)


def pattern_spans(data: np.ndarray, ends: np.ndarray) -> dict[int, list[Span]]:
    """The spans of the fixed patterns, in bytes from the start of each text, by text."""
    out: dict[int, list[Span]] = {}

    def texts_with(places: np.ndarray) -> list[int]:
        return np.unique(np.searchsorted(ends, places, side="right") - 1).tolist()

    for i in texts_with(np.flatnonzero(_SEPARATOR[data])):
        for m in ASSIGN.finditer(data[ends[i] : ends[i + 1]].tobytes()):
            if len(m[1]) >= LEAST["assign"]:
                out.setdefault(i, []).append((m.start(), 0, m.end()))
    raw = data.tobytes()
    if b"AKIA" in raw:
        at, places = raw.find(b"AKIA"), []
        while at >= 0:
            places.append(at)
            at = raw.find(b"AKIA", at + 1)
        for i in texts_with(np.array(places)):
            for m in ACCESS.finditer(raw[ends[i] : ends[i + 1]]):
                if m.end() - m.start() >= LEAST["access"]:
                    out.setdefault(i, []).append((m.start(), 1, m.end()))
    start, stop = runs(_HEX[data], ends, LEAST["hex"])
    for i, a, b in zip((np.searchsorted(ends, start, side="right") - 1).tolist(), start.tolist(), stop.tolist(), strict=True):
        out.setdefault(i, []).append((a - int(ends[i]), 2, b - int(ends[i])))
    return out


def find_spans(data: np.ndarray, ends: np.ndarray, models: MarkovPair) -> dict[int, list[Span]]:
    """All spans of the texts of a block in code points, by text, in order."""
    out = pattern_spans(data, ends)
    free = _WORD[data]
    for i, spans in out.items():
        for a, _, b in spans:
            free[ends[i] + a : ends[i] + b] = False
    for start, stop in _random_spans(data, ends, free, models):
        for i, a, b in zip((np.searchsorted(ends, start, side="right") - 1).tolist(), start.tolist(), stop.tolist(), strict=True):
            out.setdefault(i, []).append((a - int(ends[i]), 3, b - int(ends[i])))
    for i, spans in out.items():
        own = data[ends[i] : ends[i + 1]]
        before = np.zeros(len(own) + 1, np.int64)
        np.cumsum((own & 0xC0) != 0x80, out=before[1:])
        out[i] = sorted((int(before[a]), k, int(before[b])) for a, k, b in spans)
    return out


def calibrate(models: MarkovPair) -> None:
    """Set the limit by labelled strings of both kinds: the middle of where the fewest are on the wrong side."""
    random = np.sort(mean_scores(models, random_samples(1200, 15)))
    ordinary = np.sort(mean_scores(models, [w for w in identifier_samples(4000, 16, "limit") if len(w) >= LEAST["markov"]]))
    limits = np.linspace(min(ordinary[0], random[0]), max(ordinary[-1], random[-1]), 2000)
    wrong = np.searchsorted(random, limits) / len(random) + 1 - np.searchsorted(ordinary, limits) / len(ordinary)
    models.limit = float(limits[wrong == wrong.min()].mean())


def _trimmed(data: np.ndarray, start: int, stop: int, models: MarkovPair) -> tuple[int, int]:
    """The run without the parts at its ends that stand near the limit or below; at least the shortest length stays."""
    seams = start + np.flatnonzero(_PART_ENDS[data[start:stop]])
    begins, ends = np.r_[start, seams + 1], np.r_[seams, stop]
    full = ends > begins
    begins, ends = begins[full], ends[full]
    ordinary = models.mean_ratios(data, begins, ends) < 2 * models.limit  # short parts vary more
    first, last = 0, len(begins) - 1
    while first < last and ordinary[first] and ends[last] - begins[first + 1] >= LEAST["markov"]:
        first += 1
    while first < last and ordinary[last] and ends[last - 1] - begins[first] >= LEAST["markov"]:
        last -= 1
    return (int(begins[first]) if first else start), (int(ends[last]) if last < len(begins) - 1 else stop)


def _random_spans(data: np.ndarray, ends: np.ndarray, free: np.ndarray, models: MarkovPair) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs beyond the limit, without ordinary parts at their ends, and of the other runs the parts between
    separators that are beyond it."""
    start, stop = runs(free, ends, LEAST["markov"])
    hit = models.mean_ratios(data, start, stop) > models.limit
    trimmed = [_trimmed(data, a, b, models) for a, b in zip(start[hit].tolist(), stop[hit].tolist(), strict=True)]
    yield np.array([a for a, _ in trimmed], np.int64), np.array([b for _, b in trimmed], np.int64)
    rest = free & ~_PART_ENDS[data]
    for a, b in zip(start[hit].tolist(), stop[hit].tolist(), strict=True):
        rest[a:b] = False
    start, stop = runs(rest, ends, LEAST["markov"])
    hit = models.mean_ratios(data, start, stop) > models.limit
    yield start[hit], stop[hit]


def train(df: DataFrame, text: str, key: str, sample_rows: int = 2000) -> MarkovPair:
    """Models from a bounded sample of the rows; executors count transitions, the driver adds them up."""
    total = distinct_rows(df, F.col(key), F.col(text))
    chosen = df.where(sample_share(F.col(key), F.col(text)) < F.lit(sample_rows / max(total, 1)))
    sample = chosen.select(F.col(key).alias("k"), F.col(text).alias("t")).distinct()  # a row that fills the table counts once

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        secret, ordinary = np.zeros((STATES, STATES)), np.zeros((STATES, STATES))
        for data, ends, marked, start, stop in _marked_words(batches):
            words = [data[a:b].tobytes() for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
            secret += transitions([w for w, m in zip(words, marked, strict=True) if m])
            ordinary += transitions([w for w, m in zip(words, marked, strict=True) if not m])
        yield pa.RecordBatch.from_arrays([pa.array([secret.ravel().tolist()]), pa.array([ordinary.ravel().tolist()])], names=["secret", "ordinary"])

    parts = sample.mapInArrow(count, "secret array<double>, ordinary array<double>").select(F.posexplode(F.arrays_zip("secret", "ordinary")))
    sums = parts.groupBy("pos").agg(F.sum("col.secret").alias("secret"), F.sum("col.ordinary").alias("ordinary")).toPandas().sort_values("pos")
    secret, ordinary = (sums[c].to_numpy(float).reshape(STATES, STATES) if len(sums) else np.zeros((STATES, STATES)) for c in ("secret", "ordinary"))
    models = MarkovPair(secret + transitions(random_samples()), ordinary + WEIGHT * transitions(identifier_samples()))
    calibrate(models)
    return models


def _marked_words(batches: Iterator[pa.RecordBatch], least: int = 1) -> Iterator[tuple]:
    """Words of each block, and whether each overlaps a span of the patterns."""
    for _, data, ends in blocks(batches):
        start, stop = runs(_WORD[data], ends, least)
        marked = np.zeros(len(start), bool)
        for i, spans in pattern_spans(data, ends).items():
            for a, _, b in spans:
                marked[np.searchsorted(stop, ends[i] + a, side="right") : np.searchsorted(start, ends[i] + b)] = True
        yield data, ends, marked, start, stop


def scan(df: DataFrame, models: MarkovPair, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans, n_markov of every row."""
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, ends in blocks(batches):
            found = find_spans(data, ends, shared.value)
            counts = np.zeros((len(KINDS), len(ends) - 1), np.int64)
            digests, joined = [hashlib.sha256(b"").hexdigest()] * (len(ends) - 1), [""] * (len(ends) - 1)
            for i, spans in found.items():
                for _, kind, _ in spans:
                    counts[kind, i] += 1
                names = [(k, f"{KINDS[k]}:{a}:{b}") for a, k, b in spans]
                digests[i] = hashlib.sha256(",".join(n for k, n in names if k < 3).encode()).hexdigest()
                joined[i] = ",".join(n for _, n in names)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *[pa.array(c) for c in counts[:3]], pa.array(digests, pa.string()), pa.array(joined, pa.string()), pa.array(counts[3])],
                names=["k", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"],
            )

    kind = df.schema[key].dataType.simpleString()
    return (
        df.select(F.col(key).alias("k"), F.col(text).alias("t"))
        .mapInArrow(run, f"k {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")
        .withColumnRenamed("k", key)
    )


def redact(df: DataFrame, models: MarkovPair, text: str = "text", placeholder: str = PLACEHOLDER) -> DataFrame:
    """df with every secret in the text replaced by the placeholder; other columns stay as they are."""
    spark = df.sparkSession
    ship_package(spark)
    shared, column, schema = spark.sparkContext.broadcast(models), df.columns.index(text), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, ends in blocks(batches, column):
            found = find_spans(data, ends, shared.value)
            if found:
                texts = rows.column(column).to_pylist()
                for i, spans in found.items():
                    out, at = [], 0
                    for a, _, b in spans:
                        if b > at:
                            out += [texts[i][at:a], placeholder] if a >= at else []
                            at = b
                    texts[i] = "".join(out) + texts[i][at:]
                rows = rows.set_column(column, rows.schema.field(column), pa.array(texts, rows.schema.field(column).type))
            yield rows

    return df.mapInArrow(run, schema)
