"""Exact Jaccard self-join of word-shingle sets, with set-relation skipping, and its components.

Sets are ordered by one global order (shingles of one document first, then rare ones, then common
ones), and an inverted index holds the prefix of each set. Relations between sets spare most of the work:

* by position: the entries of an index list stand in blocks of equal size, in each by position. Two
  blocks whose sizes are too far apart are skipped; of the others only the entries up to the last
  position that leaves room for the least overlap are paired, the rest of the block is skipped. A
  parity bitmap of the whole set bounds the difference and skips further pairs;
* by answers: each set is first compared with one highly similar set (the smallest candidate; in a
  long list the hub), and takes over its answer, the component. Pairs within one component are
  never compared; only those that still lie apart are;
* what a long list has not settled by then is looked up again by parts: linked sets differ in d
  shingles at most, so of d + 1 parts of their shingles they agree on one whole part. This takes
  the place of pairing a common shingle's list with itself.

Equal sets are one vertex (128 hash bits), so copies cost nothing. "Common" is decided from counts over
all documents and kept in bitmaps of fixed size; a false mark there costs time, never a link.

Null and empty texts have no shingles, link with nothing and are their own component. A text of one or
two words is one shingle. Rows of one id and different texts are
compared as different texts. A null id links like any other; a component of null ids alone has a
null id. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.repeat_bitmap import bucket_bits, marked, repeat_bitmap, repeat_bitmaps
from strandline.llm.text_blocks import BLOCK_BYTES, blocks
from strandline.runtime import WAVES, discard, materialize, ship_package

SHINGLE, NUMERATOR, DENOMINATOR = 3, 9, 10
#: A shingle in more than COMMON documents is common.
COMMON = 16
BITMAP_WORDS = 8
#: Bytes of a word that is hashed as a polynomial.
SHORT_WORD = 16
#: Below so many links their labels are written by one wave of tasks.
FEW_LINKS = 1_000_000
#: Texts whose parity bits are counted at a time.
SLICE = 512
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _MIX)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2^64 and of its inverse, up to `size`."""
    global _POWERS, _INVERSES
    if len(_POWERS) < size:
        steps = np.full(size, _BASE, np.uint64)
        back = np.full(size, _INVERSE, np.uint64)
        steps[0] = back[0] = 1
        _POWERS, _INVERSES = np.multiply.accumulate(steps), np.multiply.accumulate(back)
    return _POWERS, _INVERSES


def word_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, stop, text) of every word of a block; no word spans two texts."""
    size = len(data)
    word = np.zeros(size + 2, np.int8)
    word[1:-1] = ~_SPACE[data]
    edge = np.diff(word)
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    seams = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < size)]
    seams = np.unique(seams[(word[seams] == 1) & (word[seams + 1] == 1)]) if len(seams) else seams
    if len(seams):  # a word at the end of one text and one at the start of the next
        begin, stop = np.sort(np.append(begin, seams)), np.sort(np.append(stop, seams))
    return begin, stop, np.searchsorted(ends, begin, side="right") - 1


def _word_hashes(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: a polynomial for short ones, a digest of the bytes for long ones.

    A polynomial modulo 2^64 has equal values for some long periodic words whatever its base, so it is kept to
    lengths where nearly all of its bits stay independent.
    """
    size = len(data)
    power, inverse = _powers(size + 1)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:size], out=sums[1:])
    words = _mix((sums[stop] - sums[begin]) * inverse[begin] + (stop - begin).astype(np.uint64) * _MIX)
    for i in np.flatnonzero(stop - begin > SHORT_WORD).tolist():
        low = _LOWER[data[begin[i] : stop[i]]].tobytes()
        words[i] = int.from_bytes(hashlib.blake2b(low, digest_size=8).digest(), "little")
    return words


def _sets(words: np.ndarray, owner: np.ndarray, texts: int, triples, pairs, singles) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle), sorted and distinct: names of three words each, or of all words of a text that has fewer."""
    count = np.bincount(owner, minlength=texts)
    inside = owner[:-2] == owner[2:]
    own, out = owner[:-2][inside], triples(words)[inside]
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        lone, second = words[first[short]], words[np.minimum(first[short] + 1, len(words) - 1)]
        own, out = np.append(own, short), np.append(out, np.where(count[short] == 1, singles(lone), pairs(lone, second)))
    order = np.lexsort((out, own))
    own, out = own[order], out[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (out[1:] != out[:-1])
    return own[fresh], out[fresh]


def shingles(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text of a block: (text, hash), sorted by text, then hash."""
    begin, stop, owner = word_spans(data, ends)
    triple = lambda w: _mix(_mix(_mix(w[:-2]) + w[1:-1] * _MIX) + w[2:])
    return _sets(_word_hashes(data, begin, stop), owner, len(ends) - 1, triple, lambda a, b: _mix(a * np.uint64(3) + b * _MIX), lambda a: _mix(a + np.uint64(1)))


def exact_shingles(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """shingles() with numbers that stand for the words themselves: equal in a block only where all words are."""
    begin, stop, owner = word_spans(data, ends)
    edges = np.empty(2 * len(begin) + 1, np.int64)
    edges[:-1:2], edges[1::2], edges[-1] = begin, stop, len(data)
    runs = pa.Array.from_buffers(pa.large_binary(), 2 * len(begin), [None, pa.py_buffer(edges), pa.py_buffer(_LOWER[data])])
    words = runs.take(pa.array(np.arange(0, 2 * len(begin), 2))).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    many = int(words.max(initial=0)) + 1
    pair = lambda a, b: a * many + b

    def triple(w: np.ndarray) -> np.ndarray:
        twos = np.unique(pair(w[:-2], w[1:-1]), return_inverse=True)[1]
        return pair(twos, w[2:])

    return _sets(words, owner, len(ends) - 1, triple, lambda a, b: -1 - many - pair(a, b), lambda a: -1 - a)


def _shingle_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for _, data, ends in blocks(batches):
        yield shingles(data, ends)[1]


def least_overlap(a, b):
    """The smallest intersection with which sets of these sizes reach the threshold."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def _set_hashes(own: np.ndarray, hashes: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two 64-bit hashes of the set of each text; own is sorted."""
    n = np.bincount(own, minlength=texts)
    filled = np.flatnonzero(n)
    vertex, check = np.zeros(texts, np.uint64), np.zeros(texts, np.uint64)
    if len(filled):
        starts = (np.cumsum(n) - n)[filled]
        vertex[filled] = _mix(np.add.reduceat(_mix(hashes), starts) + n[filled].astype(np.uint64))
        check[filled] = np.add.reduceat(_mix(hashes ^ _MIX), starts)
    return n, vertex, check


def _parity(own: np.ndarray, hashes: np.ndarray, texts: int) -> np.ndarray:
    """BITMAP_WORDS words for each text: parities of its shingles by slot."""
    slots, out = 64 * BITMAP_WORDS, []
    slot = (_mix(hashes + _MIX) >> np.uint64(55)).astype(np.int64)
    for at in range(0, texts, SLICE):
        a, b = np.searchsorted(own, (at, at + SLICE))
        size = min(SLICE, texts - at)
        odd = np.bincount((own[a:b] - at) * slots + slot[a:b], minlength=size * slots) & 1
        out.append(np.packbits(odd.astype(np.uint8).reshape(size, slots), axis=1, bitorder="little").view(np.int64))
    return np.concatenate(out)


def _set_rows(shared) -> callable:
    """Rows of (k, n, vertex, check, prefix, lone, rare, bitmap) for each text; see `describe`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, ends in blocks(batches):
            texts = len(ends) - 1
            own, hashes = shingles(data, ends)
            n, vertex, check = _set_hashes(own, hashes, texts)
            level = sum(marked(bitmap, hashes).astype(np.int8) for bitmap in shared.value)
            order = np.lexsort((hashes, level, own))
            hashes, level = hashes[order], level[order]
            lone, rare = np.bincount(own[level == 0], minlength=texts), np.bincount(own[level < 2], minlength=texts)
            prefix = np.where(n > 0, n - (-(-NUMERATOR * n // DENOMINATOR)) + 1, 0)
            place = np.arange(len(own)) - (np.cumsum(n) - n)[own]
            take = (place >= lone[own]) & (place < prefix[own])
            held = np.maximum(prefix - lone, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(vertex.view(np.int64)),
                    pa.array(check.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(held)], pa.int32()), pa.array(hashes[take].view(np.int64))),
                    pa.array(lone, pa.int32()),
                    pa.array(rare, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.arange(texts + 1) * BITMAP_WORDS, pa.int32()), pa.array(_parity(own, hashes, texts).ravel())),
                ],
                names=["k", "n", "vertex", "check", "prefix", "lone", "rare", "bitmap"],
            )

    return run


def describe(texts: DataFrame, bitmaps: list[np.ndarray]) -> DataFrame:
    """For each text: size of its set, hashes of the set, the part of its prefix in the global order that
    other documents may hold, the numbers of its lone and of its lone and rare shingles, and its parity bitmap."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmaps)
    kind = texts.schema["k"].dataType.simpleString()
    return texts.select("k", "t").mapInArrow(_set_rows(shared), f"k {kind}, n long, vertex long, check long, prefix array<long>, lone int, rare int, bitmap array<long>")


def block_pairs(token: np.ndarray, size: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of the same list whose sizes and positions allow the threshold.

    The entries come sorted by list, size and position. Sizes of a list are blocks; two blocks
    meet only if their sizes are near enough, and then only up to the last position of each that
    leaves room for the least overlap.
    """
    total = len(token)
    start = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (size[1:] != size[:-1])]) if total else np.zeros(0, np.int64)
    stop, width = np.r_[start[1:], total], int(place.max(initial=0)) + 2
    code = np.repeat(np.arange(len(start)), stop - start) * width + place
    for gap in count():
        i = np.arange(len(start) - gap)
        i = i[token[start[i]] == token[start[i + gap]]] if len(i) else i
        if not len(i):
            return
        j = i + gap
        i, j = (x[DENOMINATOR * size[start[i]] >= NUMERATOR * size[start[j]]] for x in (i, j))
        least = least_overlap(size[start[i]], size[start[j]])
        first, second = (np.searchsorted(code, b * width + np.clip(size[start[b]] - least, -1, width - 1), "right") - start[b] for b in (i, j))
        pairs = np.maximum(first, 0) * np.maximum(second, 0)
        held = np.flatnonzero(pairs)
        i, j, second, pairs = i[held], j[held], second[held], pairs[held]
        nth = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        across = np.repeat(second, pairs)
        a, b = np.repeat(start[i], pairs) + nth // np.maximum(across, 1), np.repeat(start[j], pairs) + nth % np.maximum(across, 1)
        yield (a[a < b], b[a < b]) if gap == 0 else (a, b)


def _light_pairs(sets: DataFrame, bits: int) -> DataFrame:
    """(a, b): pairs that share a rare shingle of their prefixes and pass the bounds on size and position.

    A rare shingle is in few documents, so its list is short; lists are dealt evenly by their hash.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, lone = batch.column("prefix"), batch.column("lone").to_numpy()
            sizes = np.diff(np.asarray(lists.offsets))
            token = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lone[row]
            keep = place < batch.column("rare").to_numpy()[row]
            token, row, place = token[keep], row[keep], place[keep]
            bucket = (token.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else bucket
            cuts = np.r_[starts, len(bucket)].tolist()
            columns = [token, batch.column("id").to_numpy()[row], batch.column("n").to_numpy()[row], place.astype(np.int64)]
            packed = np.stack([c[order] for c in columns], 1)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array([packed[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["bucket", "entries"])

    def pair(group: pa.Table) -> pa.Table:
        entries = np.concatenate([np.frombuffer(e.as_py(), np.int64).reshape(-1, 4) for e in group.column("entries")])
        token, name, size, place = entries[np.lexsort((entries[:, 3], entries[:, 2], entries[:, 0]))].T
        found = [np.zeros((0, 2), np.int64)]
        for a, b in block_pairs(token, size, place):
            found.append(np.stack([np.minimum(name[a], name[b]), np.maximum(name[a], name[b])], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    sent = sets.select("id", "n", "prefix", "lone", "rare").mapInArrow(send, "bucket int, entries binary")
    return sent.groupBy("bucket").applyInArrow(pair, "a long, b long")


def _long_lists(sets: DataFrame) -> DataFrame:
    """(token, class, id, n, place, rare): prefix entries of common shingles, by size class.

    Sets that can link are in one class or in neighbouring ones, so each entry stands in two.
    """
    level = F.floor(F.log(F.col("n")) / F.lit(float(np.log(DENOMINATOR / NUMERATOR)))).cast("int")
    entries = sets.where(F.col("rare") < F.col("lone") + F.size("prefix")).select("id", "n", "rare", "lone", F.posexplode("prefix").alias("at", "token"))
    entries = entries.withColumn("place", F.col("at") + F.col("lone")).where(F.col("place") >= F.col("rare"))
    return entries.select("token", F.explode(F.array(level, level + 1)).alias("class"), "id", "n", "place", "rare")


def _fits(na: str, nb: str, ba: str, bb: str) -> Column:
    """Whether sizes and parity bitmaps of two sets allow the threshold."""
    differ = sum((F.bit_count(F.col(ba)[i].bitwiseXOR(F.col(bb)[i])) for i in range(BITMAP_WORDS)), F.lit(0))
    # overlap o >= 9 (na + nb) / 19, and the sets differ in na + nb - 2 o shingles at most
    near = DENOMINATOR * F.least(na, nb) >= NUMERATOR * F.greatest(na, nb)
    return near & (differ * (NUMERATOR + DENOMINATOR) <= (F.col(na) + F.col(nb)) * (DENOMINATOR - NUMERATOR))


def _bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and bitmaps allow the threshold."""
    a = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ba"))
    b = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("bb"))
    return pairs.distinct().join(a, "a").join(b, "b").where(_fits("na", "nb", "ba", "bb")).select("a", "b")


def _wanted_texts(texts: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, t): one text of each wanted set, read once and written for all comparisons.

    A bitmap of text hashes picks the rows, the hashes of their sets decide.
    """
    named = sets.join(wanted.distinct(), "id", "left_semi").select("id", "vertex", "check", "rep")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield _mix(batch.column(0).to_numpy().view(np.uint64))

    named = materialize(named, "jaccard-named")
    shared = texts.sparkSession.sparkContext.broadcast(repeat_bitmap(named.select("rep"), hashes, 0))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.flatnonzero(marked(shared.value, _mix(batch.column(0).to_numpy().view(np.uint64))))
            for rows, data, ends in blocks(iter([batch.take(pa.array(keep))])):
                _, vertex, check = _set_hashes(*shingles(data, ends), len(ends) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(vertex.view(np.int64)), pa.array(check.view(np.int64)), rows.column(1)], names=["vertex", "check", "t"])

    found = texts.select("body", "t").mapInArrow(pick, "vertex long, check long, t string").dropDuplicates(["vertex", "check"])
    return materialize(found.join(named, ["vertex", "check"]).select("id", "t"), "jaccard-texts")


def _verify(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """(a, b) of the pairs that link, by the exact overlap of their sets: words are compared, not hashes."""

    def both_sides(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(text, shingle) of the left texts, then of the right ones, named alike."""
        texts = pa.concat_arrays([rows.column("ta"), rows.column("tb")])
        _, data, ends = next(blocks(iter([pa.RecordBatch.from_arrays([texts], names=["t"])]), 0, 1 << 62))
        return exact_shingles(data, ends)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.add(pc.binary_length(batch.column("ta")), pc.binary_length(batch.column("tb"))).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_BYTES, side="right")))
                own, names = both_sides(batch.slice(at, to - at))
                own = own % (to - at)
                order = np.lexsort((names, own))
                own, names = own[order], names[order]
                both = np.bincount(own[1:][(own[1:] == own[:-1]) & (names[1:] == names[:-1])], minlength=to - at)
                union = np.bincount(own, minlength=to - at) - both
                linked = pa.array(np.flatnonzero(DENOMINATOR * both >= NUMERATOR * union) + at)
                yield pa.RecordBatch.from_arrays([batch.column("a").take(linked), batch.column("b").take(linked)], names=["a", "b"])
                at = to

    left, right = full.select(F.col("id").alias("a"), F.col("t").alias("ta")), full.select(F.col("id").alias("b"), F.col("t").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of different components."""
    a, b = labels.select(F.col("vertex").alias("a"), F.col("label").alias("la")), labels.select(F.col("vertex").alias("b"), F.col("label").alias("lb"))
    return pairs.join(a, "a").join(b, "b").where("la != lb").select("a", "b")


def components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(vertex, label): the smallest vertex reachable, by label passing and pointer jumping.

    Each round writes its labels to the shared folder, so lineage stays short.
    """
    both = materialize(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct(), "links")
    waves = 1 if both.count() < FEW_LINKS else WAVES
    held = labels = materialize(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")).select(F.col("x").alias("vertex"), "label"), "labels", waves)
    while True:
        passed = both.join(labels.withColumnRenamed("vertex", "y"), "y").groupBy("x").agg(F.min("label").alias("near")).withColumnRenamed("x", "vertex")
        stepped = labels.join(passed, "vertex").select("vertex", F.least("label", "near").alias("to"), F.col("label").alias("before"))
        jumps = labels.select(F.col("vertex").alias("to"), F.col("label").alias("beyond"))
        following = materialize(stepped.join(jumps, "to").select("vertex", F.least("to", "beyond").alias("label"), "before"), "labels", waves)
        changed = following.where(F.col("label") != F.col("before")).limit(1).count()
        discard(held)
        held, labels = following, following.select("vertex", "label")
        if not changed:
            discard(both)
            return vertices.join(labels, "vertex", "left").select("vertex", F.coalesce("label", "vertex").alias("label"))


def _hub_pairs(lists: DataFrame) -> DataFrame:
    """(a, b): each entry of a long list with the hub of the list, the set of the fewest rare shingles."""
    hub = lists.groupBy("token", "class").agg(F.min(F.struct("rare", "id", "n", "place")).alias("h"), F.count("*").alias("m")).where("m > 1")
    near = lists.join(hub.select("token", "class", F.col("h.id").alias("hub"), F.col("h.n").alias("hn"), F.col("h.place").alias("hp")), ["token", "class"]).where("id != hub")
    reach = F.least(F.col("n") - F.col("place"), F.col("hn") - F.col("hp"))
    near = near.where((reach * (NUMERATOR + DENOMINATOR) >= (F.col("n") + F.col("hn")) * NUMERATOR) & (DENOMINATOR * F.least("n", "hn") >= NUMERATOR * F.greatest("n", "hn")))
    return near.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))


def _part_keys(members: DataFrame) -> DataFrame:
    """(key, id, label) of members (id, class, label, t): the parts of a set on which sets that it links to agree.

    Two linked sets of a class differ in d shingles at most, so of d + 1 parts one is equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, ends in blocks(batches, 3):
            own, hashes = shingles(data, ends)
            level = rows.column("class").to_numpy().astype(np.int64)
            largest = np.ceil((DENOMINATOR / NUMERATOR) ** (level + 1.0)).astype(np.int64) + 1
            parts = 2 * largest * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR) + 1
            first = np.cumsum(parts) - parts
            part = first[own] + (_mix(hashes ^ np.uint64(0x5BD1E995)) % parts[own].astype(np.uint64)).astype(np.int64)
            sums = np.zeros(int(parts.sum()), np.uint64)
            np.add.at(sums, part, _mix(hashes + np.uint64(0x1B873593)))
            row = np.repeat(np.arange(len(parts)), parts)
            nth = (np.arange(len(row)) - first[row]).astype(np.uint64)
            keys = _mix(_mix(sums) + nth * _MIX + level[row].astype(np.uint64) * np.uint64(0xE6546B64))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), rows.column("id").take(take), rows.column("label").take(take)], names=["key", "id", "label"])

    return members.select("id", "class", "label", "t").mapInArrow(run, "key long, id long, label long")


def _part_pairs(lists: DataFrame, labels: DataFrame, full: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): sets of different components that share a long list, agree on a part and fit by size and bitmap.

    The bounds are conditions of the join itself, so that what cannot link is never written.
    """
    placed = lists.select("token", "class", F.col("id").alias("vertex")).join(labels, "vertex")
    mixed = placed.groupBy("token", "class").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("token", "class")
    members = placed.join(mixed, ["token", "class"]).select(F.col("vertex").alias("id"), "class", "label").distinct()
    keys = materialize(_part_keys(members.join(full, "id")), "jaccard-parts")
    # of each key the largest component is one side only, so that copies of one text never meet each other
    main = keys.groupBy("key", "label").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "label")).alias("x"), F.count("*").alias("labels")).where("labels > 1").select("key", F.col("x.label").alias("main"))
    split = keys.join(main, "key").join(sets.select("id", "n", "bitmap"), "id")
    asks = split.where("label != main").select("key", F.col("id").alias("ask"), F.col("label").alias("own"), F.col("n").alias("an"), F.col("bitmap").alias("ab"))
    met = split.join(asks, "key").where(F.expr("label != own AND (label = main OR id < ask)") & _fits("n", "an", "bitmap", "ab"))
    return met.select(F.least("id", "ask").alias("a"), F.greatest("id", "ask").alias("b")).distinct()


def join_sets(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows k, n, label; components vertex, label of all sets) of texts (row, body, t)."""
    ship_package(texts.sparkSession)
    plain = texts.select(F.col("row").alias("k"), "t")
    bitmaps = repeat_bitmaps(plain, _shingle_hashes, [1, COMMON])
    rows = materialize(describe(plain, bitmaps), "jaccard-rows")
    same = [F.first(c).alias(c) for c in ("n", "prefix", "lone", "rare", "bitmap")]
    found = rows.where(F.col("n") > 0).groupBy("vertex", "check").agg(F.min("k.body").alias("rep"), *same)
    sets = materialize(found.withColumn("id", F.monotonically_increasing_id()), "jaccard-sets")
    lists = materialize(_long_lists(sets), "jaccard-lists")
    candidates = materialize(_bounded(_light_pairs(sets, bucket_bits(plain)).unionByName(_hub_pairs(lists)), sets), "jaccard-pairs")
    crowded = lists.join(lists.groupBy("token", "class").agg(F.count("*").alias("m")).where("m > 1"), ["token", "class"], "left_semi").select("id")
    full = _wanted_texts(texts, sets, candidates.select(F.explode(F.array("a", "b")).alias("id")).unionByName(crowded))
    # each set and its first candidate; those that link have one answer, and pairs within it are skipped
    links = materialize(_verify(candidates.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), full), "jaccard-links")
    vertices = sets.select(F.col("id").alias("vertex"))
    labels = components(vertices, links)
    for further in (lambda: _apart(candidates, labels), lambda: _part_pairs(lists, labels, full, sets)):
        fresh = materialize(_verify(further(), full), "jaccard-links")
        if fresh.limit(1).count():
            links = links.unionByName(fresh)
            labels = components(vertices, links)
    names = sets.select("vertex", "check", "id").join(labels.withColumnRenamed("vertex", "id"), "id").select("vertex", "check", "label")
    placed = rows.select("k", "n", "vertex", "check").join(names, ["vertex", "check"], "left").select("k", "n", F.when(F.col("n") > 0, F.col("label")).alias("label"))
    out = materialize(placed, "jaccard-placed")
    labels = materialize(labels, "jaccard-labels")
    for used in (rows, sets, lists, candidates, full):
        discard(used)
    return out, labels


def placed_rows(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, body, n, component of every row: the id and the hash of the text, the size of its set and the
    component of its vertex, null where the set is empty."""
    body = F.xxhash64(text)
    texts = documents.select(F.struct(F.col(key).alias("id"), body.alias("body")).alias("row"), body.alias("body"), F.col(text).alias("t"))
    placed, _ = join_sets(texts)
    return placed.select("k.id", "k.body", "n", F.col("label").alias("component"))


def cluster(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    placed = placed_rows(documents, key, text)
    names = placed.where(F.col("n") > 0).groupBy("component").agg(F.min("id").alias("name"))
    out = placed.where(F.col("n") > 0).join(names, "component").select("id", "n", "name").unionByName(placed.where(F.col("n") == 0).select("id", "n", F.col("id").alias("name")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("name").alias("component_id"))
