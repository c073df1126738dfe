"""Byte-level BPE over length-bucketed, padded numpy matrices.

Each matrix row is one pre-token. A round finds every row's leftmost pair of least rank (argmin returns the first),
merges it, looks the two new neighbour pairs up in a hashed table and compacts the row; rows without a mergeable pair
leave the matrix. Distinct pre-tokens are encoded once per task and kept in a memo of bounded bytes.

A pre-token of more than LONG bytes (text without spaces) is first cut where no token of the vocabulary can reach across:
at a place whose two bytes on either side stand so in no token. Merges never cross such a place, so the parts are rows of
the matrices like others and unspaced text costs as much a byte as other text. Only a part that is still longer, as a run
of one character may be, is merged alone, with the least rank of each block of its positions kept.

Defined cases: null text counts as empty and gives no ids; ids of one document depend on its text only, so ties and
repeated rows give equal results; other columns are ignored; an empty table gives an empty result. Pre-tokens of any
length are encoded whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import cached_property
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import map_arrow

NONE = np.int32(2**31 - 1)
#: The longest row of a matrix.
LONG = 256
#: Fixed value: the pattern whose matches never span a single space but from that space on.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space between two characters of which neither is white space (re counts at least what regex counts).
SINGLE = re.compile(r"(?<=\S) (?=\S)")
LAST = itemgetter(-1)
#: Bytes of the memo of one Python worker, and the longest string that it takes.
MEMO, REMEMBERED = 96 << 20, 256


class Memo(dict):
    """Ids by string. Over MEMO bytes it is emptied, at the next call of encode()."""

    held = 0

    def remember(self, found: dict[str, bytes]) -> None:
        some = {k: v for k, v in found.items() if len(k) <= REMEMBERED}
        self.held += 250 * len(some) + sum(map(len, some)) * 2 + sum(map(len, some.values()))
        self.update(some)

    def trim(self) -> None:
        if self.held > MEMO:
            self.clear()
            self.held = 0


class Vocabulary:
    """Ranks of byte strings, and the table of mergeable id pairs."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern

    def __reduce__(self):
        return Vocabulary, (self.ranks, self.pattern)

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    @cached_property
    def split(self):
        return regex.compile(self.pattern).findall

    @cached_property
    def tokens(self) -> list[bytes]:
        out = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            out[rank] = token
        return out

    @cached_property
    def bytes_to_ids(self) -> np.ndarray:
        return np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    @cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Open addressing with linear probing: keys (left << 32 | right) and ids of the merged token."""
        get, pairs = self.ranks.get, {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        bits = max(4, (4 * len(pairs)).bit_length())
        slots, merged = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        keys, ids = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        at = self._hash(keys, bits)
        while len(keys):
            free = slots[at] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            slots[at[put]], merged[at[put]] = keys[put], ids[put]
            keys, ids, at = keys[~put], ids[~put], (at[~put] + ~free[~put]) & ((1 << bits) - 1)
        return slots, merged, bits

    @staticmethod
    def _hash(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it isn't mergeable or an end is padding (-1)."""
        slots, merged, bits = self._table
        keys = left.astype(np.int64).ravel() << 32 | right.astype(np.int64).ravel()
        keys[(left.ravel() < 0) | (right.ravel() < 0)] = -2
        out = np.full(len(keys), NONE, np.int32)
        at, open_ = self._hash(keys, bits), np.flatnonzero(keys >= 0)
        at = at[open_]
        while len(open_):
            found = slots[at]
            hit = found == keys[open_]
            out[open_[hit]] = merged[at[hit]]
            on = ~hit & (found != -1)
            open_, at = open_[on], (at[on] + 1) & ((1 << bits) - 1)
        return out.reshape(left.shape)

    @cached_property
    def _crossings(self) -> list[np.ndarray]:
        """What stands around the places inside tokens, two bytes on either side or one where the token has no more: sorted numbers."""
        found: list[set[int]] = [set(), set(), set(), set()]
        for token in self.ranks:
            for i in range(1, len(token)):
                left, right = token[max(0, i - 2) : i], token[i : i + 2]
                found[2 * (len(left) - 1) + len(right) - 1].add(int.from_bytes(left + right, "big"))
        return [np.array(sorted(x), np.int64) for x in found]

    def parts(self, raw: bytes) -> list[bytes]:
        """Cut where no token reaches across."""
        b = np.frombuffer(raw, np.uint8).astype(np.int64)
        left, right = b[:-1], b[1:]
        left2 = np.append(-1 << 40, left[:-1] << 8 | left[1:])
        right2 = np.append(right[:-1] << 8 | right[1:], -1 << 40)
        crossed = np.zeros(len(left), bool)
        for known, keys in zip(self._crossings, (left << 8 | right, left << 16 | right2, left2 << 8 | right, left2 << 16 | right2), strict=True):
            if len(known):
                crossed |= known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
        cuts = [0, *(np.flatnonzero(~crossed) + 1).tolist(), len(raw)]
        return [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    @cached_property
    def byte_pairs(self) -> np.ndarray:
        """Rank of every pair of single bytes."""
        left = np.repeat(self.bytes_to_ids, 256)
        return self.pair_ranks(left, np.tile(self.bytes_to_ids, 256)).reshape(256, 256)

    def encode_matrix(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian ids of byte strings of similar length, LONG bytes at most.

        A row of the method is a column here (positions run down the first axis), so minima are taken over
        contiguous memory. A rank and its position make one number, so one minimum gives both.
        """
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width).T
        position = np.arange(width, dtype=np.int64)[:, None]
        ids = np.where(position < lengths, self.bytes_to_ids[raw], np.int32(-1))
        ranks = np.where(position[1:] < lengths, self.byte_pairs[raw[:-1], raw[1:]], NONE)
        out: list = [None] * len(pieces)
        rows, none = np.arange(len(pieces)), int(NONE) << 9
        while len(rows):
            if len(ranks):
                least = ((ranks.astype(np.int64) << 9) | position[: len(ranks)]).min(axis=0)
                done = least >= none
            else:
                done = np.ones(len(rows), bool)
            if done.any():
                ended = ids[:, done].T
                real = ended >= 0
                flat, ends = ended[real].astype("<u4").tobytes(), (real.sum(axis=1).cumsum() * 4).tolist()
                start = 0
                for k, end in zip(rows[done].tolist(), ends, strict=True):
                    out[k] = flat[start:end]
                    start = end
                keep = ~done
                rows = rows[keep]
                if not len(rows):
                    break
                ids, ranks, least = ids[:, keep], ranks[:, keep], least[keep]
            at, here = least & 511, np.arange(len(rows))
            ids[at, here] = least >> 9
            stay = position[: len(ids) - 1] <= at
            ids = np.where(stay, ids[:-1], ids[1:])
            ranks = np.where(position[: len(ranks) - 1] < at, ranks[:-1], ranks[1:])
            for near in (at - 1, at):
                k = here[(near >= 0) & (near < len(ranks))]
                i = near[k]
                ranks[i, k] = self.pair_ranks(ids[i, k], ids[i + 1, k])
        return out

    def encode_long(self, piece: bytes) -> np.ndarray:
        """One row that nothing cuts: the same rounds, over linked positions with the least rank of every block of positions."""
        n = len(piece)
        block = max(16, int(n**0.5))
        ids = self.bytes_to_ids[np.frombuffer(piece, np.uint8)]
        ranks = np.full(-(-n // block) * block, NONE, np.int32)
        ranks[: n - 1] = self.pair_ranks(ids[:-1], ids[1:])
        blocks = ranks.reshape(-1, block)
        least = blocks.min(axis=1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known: dict[tuple[int, int], int] = {}

        def rank(i: int, j: int) -> int:
            if i < 0 or j >= n:
                return int(NONE)
            key = (int(ids[i]), int(ids[j]))
            if key not in known:
                known[key] = int(self.pair_ranks(np.array([key[0]]), np.array([key[1]]))[0])
            return known[key]

        while True:
            k = int(least.argmin())
            if least[k] == NONE:
                break
            i = k * block + int(blocks[k].argmin())
            j = after[i]
            ids[i], after[i] = ranks[i], after[j]
            if after[j] < n:
                before[after[j]] = i
            changed = {k, j // block}
            ids[j], ranks[j], ranks[i] = -1, NONE, rank(i, after[i])
            if before[i] >= 0:
                ranks[before[i]] = rank(before[i], i)
                changed.add(before[i] // block)
            for k in changed:
                least[k] = blocks[k].min()
        return ids[ids >= 0]

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Distinct pre-tokens and their ids as little-endian unsigned 32-bit integers."""
        out: dict[str, bytes] = {}
        rows: dict[bytes, bytes] = {}
        cut: dict[str, list[bytes]] = {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                out[piece] = whole.to_bytes(4, "little")
            else:
                cut[piece] = self.parts(raw) if len(raw) > LONG else [raw]
        buckets: dict[int, list[bytes]] = {}
        for raw in set().union(*cut.values()):
            n = len(raw)
            if n > LONG:
                rows[raw] = self.encode_long(raw).astype("<u4").tobytes()
            else:
                buckets.setdefault(n if n <= 24 else -(-n // 8) * 8 if n <= 64 else -(-n // 64) * 64, []).append(raw)
        for width, group in buckets.items():
            step = max(1, (1 << 16) // width)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                rows.update(zip(part, self.encode_matrix(part), strict=True))
        out.update((piece, b"".join(map(rows.__getitem__, raws))) for piece, raws in cut.items())
        return out

    def encode_runs(self, runs: list[str], lead: str) -> list[bytes]:
        """Ids of lead + run for each run. Letters, or letters and a sign, need no search for the pattern's matches."""
        split, signs = [], {sign: self.encode_pieces([sign])[sign] for sign in ".,"}
        for run in runs:
            if run.isalpha():
                split.append((lead + run, b""))
            elif run[:-1].isalpha() and run[-1] in signs:
                split.append((lead + run[:-1], signs[run[-1]]))
            else:
                split.append((self.split(lead + run), None))
        pieces = {a for a, b in split if b is not None}.union(*(a for a, b in split if b is None))
        ids = self.encode_pieces(pieces).__getitem__
        return [b"".join(map(ids, a)) if b is None else ids(a) + b for a, b in split]

    def encode(self, texts: list[str], memo: Memo) -> list[bytes]:
        """memo: ids of runs with a space before each, or of pre-tokens where the pattern isn't SPACED.

        No match of SPACED spans a single space between two other characters but from that space on, so the ids of a
        text are those of its parts, each later part with its space. Other white space stays within parts.
        """
        memo.trim()
        if self.pattern != SPACED:
            split = [self.split(t) for t in texts]
            fresh = self.encode_pieces(set().union(*split).difference(memo))
            ids = fresh | {p: memo[p] for p in set().union(*split).difference(fresh)}
            memo.remember(fresh)
            return [b"".join(map(ids.__getitem__, p)) for p in split]
        parts = [t.split(" ") for t in texts]
        for k, p in enumerate(parts):
            if "" in p or any(map(str.isspace, set(map(LAST, p)))):
                parts[k] = SINGLE.split(texts[k]) if texts[k] else []
        found = [list(map(memo.get, p)) for p in parts]
        new = list({x for p, f in zip(parts, found, strict=True) if None in f for x, y in zip(p, f, strict=True) if y is None})
        fresh = dict(zip(new, self.encode_runs(new, " "), strict=True))
        memo.remember(fresh)
        firsts = iter(self.encode_runs([p[0] for p in parts if p], ""))
        out = []
        for p, f in zip(parts, found, strict=True):
            if None in f:
                f = [fresh[x] if y is None else y for x, y in zip(p, f, strict=True)]
            if p:
                f[0] = next(firsts)
            out.append(b"".join(f))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(df: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id", text_column: str = "text", decoded: bool = False) -> DataFrame:
    """Per row: id_column, n_tokens long, ids binary (little-endian unsigned 32-bit). No shuffle.

    With `decoded` also the bytes that those ids stand for, decoded in the same Python worker.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)  # as large as the vocabulary file, whatever the input

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memo = shared.value, Memo()
        for batch in batches:
            ids = own.encode([t or "" for t in batch.column(1).to_pylist()], memo)
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            columns = {id_column: batch.column(0), "n_tokens": counts, "ids": pa.array(ids, pa.binary())}
            if decoded:
                columns["decoded"] = pa.array(map(own.decode, ids), pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = df.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_tokens bigint, ids binary" + ", decoded binary" * decoded
    return map_arrow(df.select(id_column, text_column), work, schema)


def decode(df: DataFrame, vocabulary: Vocabulary, ids_column: str = "ids") -> DataFrame:
    """Add `decoded`, the bytes that ids_column stands for; null where that is null."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    at = df.columns.index(ids_column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = [None if x is None else own.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return map_arrow(df, work, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", decoded binary")


def round_trip(spark: SparkSession, df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    both = encode(df, vocabulary, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
