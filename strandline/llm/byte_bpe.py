"""Byte-level BPE by monoid tree reduction.

A piece (one match of the split pattern) is encoded by halves. Two neighbouring token lists are
joined by re-encoding a window around the seam and growing it until both of its outer token pairs
are compatible: a token list is the BPE encoding of its bytes exactly when every adjacent pair
encodes to itself, so once the outer pairs hold, nothing outside the window can change.
Decoding concatenates token bytes up the same kind of tree.

Null texts count as empty: no tokens, digests of the empty string. Repeated rows give repeated
rows; an empty table gives an empty table; columns besides the key and the text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.runtime import ship_package

LEAF_BYTES = 16
#: Distinct pieces a worker remembers before it starts afresh; a bound on memory, not on results.
MEMO_PIECES = 250_000


class ByteBpe:
    """Encoder and decoder over one rank table; built once per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern)
        plain = pattern.replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        self.plain_split = None if "\\p" in plain else re.compile(plain)
        self.pair_keys, self.pair_ids = _pair_table(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)])
        self._pairs: dict[tuple[int, int], bool] = {}
        self.windows = _Memo(self.merge)
        self.pieces = _Memo(self._piece)

    def find_pieces(self, text: str) -> list[str]:
        """The matches of the pattern.

        On Latin-1 text without the few characters in which they differ, the standard engine's
        classes mean the same as the Unicode properties, and scan twice as fast.
        """
        if self.plain_split is not None and (text.isascii() or text.translate(_LATIN).isascii()) and not _DIFFER.search(text):
            return self.plain_split.findall(text)
        return self.split.findall(text)

    # encoding -----------------------------------------------------------------------------

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE of a short byte string: lowest rank first, leftmost on ties."""
        if len(data) > 64:
            return self._merge_heap(data)
        get, none = self.ranks.get, len(self.ranks) + (1 << 40)
        parts = [data[i : i + 1] for i in range(len(data))]
        costs = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while costs:
            best = min(costs)
            if best == none:
                break
            i = costs.index(best)
            merged = parts[i] = parts[i] + parts.pop(i + 1)
            del costs[i]
            if i:
                costs[i - 1] = get(parts[i - 1] + merged, none)
            if i < len(costs):
                costs[i] = get(merged + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def _merge_heap(self, data: bytes) -> list[int]:
        """The same for long windows, with a heap over a linked list of parts."""
        ranks, n = self.ranks, len(data)
        ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ends[j] != end:
                continue
            alive[j], ends[i], after[i] = False, end, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(data[i : ends[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, ends[after[i]]))
            if (p := before[i]) >= 0 and (r := ranks.get(data[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        return [ranks[data[i : ends[i]]] for i in range(n) if alive[i]]

    def merge_many(self, items: list[bytes]) -> list[list[int]]:
        """merge() of many short byte strings at once: in each round every string does its next merge."""
        owner = np.repeat(np.arange(len(items)), [len(x) for x in items])
        tokens = self.byte_ids[np.frombuffer(b"".join(items), np.uint8)]
        final_owner, final_tokens, final_place = [], [], []
        place = np.arange(len(tokens))
        while len(tokens):
            costs = self._costs(tokens, owner)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(tokens)])
            best = np.minimum.reduceat(costs, starts)
            going = np.repeat(best < _NONE, sizes)
            done = ~going
            final_owner.append(owner[done])
            final_tokens.append(tokens[done])
            final_place.append(place[done])
            hit = np.flatnonzero(going & (costs == np.repeat(best, sizes)))
            first = hit[np.r_[True, owner[hit][1:] != owner[hit][:-1]]] if len(hit) else hit
            tokens[first] = costs[first]
            going[first + 1] = False
            tokens, owner, place = tokens[going], owner[going], place[going]
        place = np.concatenate(final_place)
        order = np.argsort(place)
        tokens, owner = np.concatenate(final_tokens)[order].tolist(), np.concatenate(final_owner)[order]
        ends = np.searchsorted(owner, np.arange(len(items)), side="right").tolist()
        return [tokens[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _costs(self, tokens: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """For each token, the rank of what it makes with its right neighbour, or _NONE."""
        out = np.full(len(tokens), _NONE)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        keys = (tokens[inside] << 32) | tokens[inside + 1]
        slot = _slot(keys)
        found = np.full(len(keys), _NONE)
        open_ = np.arange(len(keys))
        while len(open_):
            held = self.pair_keys[slot]
            same = held == keys[open_]
            found[open_[same]] = self.pair_ids[slot[same]]
            go = ~same & (held >= 0)
            open_, slot = open_[go], (slot[go] + 1) & (_SLOTS - 1)
        out[inside] = found
        return out

    def prime(self, pieces: list[str]) -> None:
        """Encode in bulk the leaves of the pieces not met before."""
        leaves = set()
        for piece in set(pieces).difference(self.pieces):
            data = piece.encode()
            if len(data) <= LEAF_BYTES and data not in self.ranks:
                leaves.add(data)
        leaves = list(leaves.difference(self.windows))
        for at in range(0, len(leaves), 50_000):
            part = leaves[at : at + 50_000]
            self.windows.update(zip(part, self.merge_many(part), strict=True))

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, encode to themselves."""
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > MEMO_PIECES:
                self._pairs.clear()
            known = self._pairs[key] = self.windows[self.token_bytes[left] + self.token_bytes[right]] == [left, right]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded neighbours: an associative operation."""
        if not left or not right:
            return left or right
        if self.compatible(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.windows[b"".join(map(self.token_bytes.__getitem__, left[-i:] + right[:j]))]
            left_ok = i >= len(left) or self.compatible(left[-i - 1], window[0])
            right_ok = j >= len(right) or self.compatible(window[-1], right[j])
            if left_ok and right_ok:
                return left[: len(left) - i] + window + right[j:]
            i = i if left_ok else min(len(left), 2 * i)
            j = j if right_ok else min(len(right), 2 * j)

    def encode_piece(self, data: bytes) -> list[int]:
        """One piece: a token of the table as it is, anything else by the tree."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self._tree(data)

    def _tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.windows[data]
        middle = len(data) // 2
        return self.join(self._tree(data[:middle]), self._tree(data[middle:]))

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.find_pieces(text) for i in self.encode_piece(piece.encode())]

    # decoding -----------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> bytes:
        """Token bytes, concatenated up a tree."""
        if len(ids) <= 64:
            return b"".join(map(self.token_bytes.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])

    # digests ------------------------------------------------------------------------------

    def _piece(self, piece: str) -> tuple[str, bytes]:
        """Decimal ids joined by spaces, and the bytes that these ids decode to."""
        ids = self.encode_piece(piece.encode())
        return " ".join(map(str, ids)), self.decode(ids)

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: number of tokens, digest of the ids, digest of the decoded bytes."""
        self.windows.trim()
        self.pieces.trim()
        split = [self.find_pieces(text) for text in texts]
        self.prime(list(chain.from_iterable(split)))
        return [self._digest(pieces) for pieces in split]

    def _digest(self, pieces: list[str]) -> tuple[int, str, str]:
        ids_hash, bytes_hash, count = hashlib.sha256(), hashlib.sha256(), 0
        for at in range(0, len(pieces), 65_536):
            names, spelled = zip(*map(self.pieces.__getitem__, pieces[at : at + 65_536]), strict=True)
            joined = " ".join(names)
            ids_hash.update((" " + joined if at else joined).encode())
            bytes_hash.update(b"".join(spelled))
            count += joined.count(" ") + 1
        return count, ids_hash.hexdigest(), bytes_hash.hexdigest()


_NONE, _SLOT_BITS = 1 << 40, 20
_SLOTS = 1 << _SLOT_BITS
_LATIN = {c: "a" for c in range(0x80, 0x100)}
_DIFFER = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc\xbd\xbe]")


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def _pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """An open-addressed table from two neighbouring tokens to the token they make."""
    known = [((ranks[t[:i]] << 32) | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    keys, ids = np.full(_SLOTS, -1), np.zeros(_SLOTS, np.int32)
    for (key, rank), slot in zip(known, _slot(np.array([k for k, _ in known])).tolist(), strict=True):
        while keys[slot] >= 0:
            slot = (slot + 1) & (_SLOTS - 1)
        keys[slot], ids[slot] = key, rank
    return keys, ids


class _Memo(dict):
    """A dictionary that computes what it lacks and starts afresh when it has grown too large."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self[key] = self.compute(key)
        return value

    def trim(self) -> None:
        if len(self) > MEMO_PIECES:
            self.clear()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the text of a tiktoken file: base64 token, space, rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


_CODERS: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """The worker's coder for a rank file; the file is installed with a library on every machine."""
    key = (path, pattern)
    if key not in _CODERS:
        with open(path, "rb") as file:
            _CODERS[key] = ByteBpe(parse_ranks(file.read()), pattern)
    return _CODERS[key]


def encode_documents(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids (array of int) and decoded text bytes of every row, for use of the tokens."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            for block in _blocks(batch):
                ids = [bpe.encode(t or "") for t in block.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, ids), pa.binary())],
                    names=["k", "n_tokens", "ids", "decoded"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_tokens long, ids array<int>, decoded binary").withColumnRenamed("k", key)


def token_digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of every row.

    One narrow pass: a row's tokens never leave its task, so nothing is shuffled and a lost task
    is simply run again.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            for block in _blocks(batch):
                done = bpe.digests([t or "" for t in block.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.string())],
                    names=["k", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("k", key)


def _blocks(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
