"""SimHash near-dedup by pigeonhole blocks.

A fingerprint is split into six blocks. Two fingerprints that differ in three bits at most agree in three blocks or
more, so each of the twenty choices of three blocks gives a key, and every close pair shares one. Equal fingerprints
are joined into one before that, so copies cost nothing here. A block's fingerprints arrive sorted in one task, which
verifies Hamming distances and passes on a spanning forest, never all pairs; links then meet in distributed
components.

Defined cases: null text counts as empty; no words give fingerprint zero, which links like any other; fewer than three
words make one shingle; a null id (as one that isn't an integer) is a row of its own that takes part like others and is
the smallest id only of a component without ids; repeated rows each get their row, and deduplicate() leaves one row of a
component: of the smallest id, then of the smallest hash of id and text; other columns are ignored; an empty table gives an empty
result. Words, shingles and documents of any length are whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import components, cut, leave, map_arrow, row_key_of, staged, texts_of, whole_id

WORDS, SEED, DISTANCE = 3, 42, 3
#: Six blocks of bits; a key is what is left of a fingerprint under a mask of three.
WIDTHS = (11, 11, 11, 11, 10, 10)
STARTS = np.cumsum((0, *WIDTHS))
BLOCKS = [((1 << w) - 1) << int(s) for w, s in zip(WIDTHS, STARTS, strict=False)]
MASKS = [a | b | c for a, b, c in combinations(BLOCKS, 3)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
    n = len(words) - WORDS + 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :].tolist(), strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 17):
        counts += np.unpackbits(hashes[i : i + (1 << 17)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fp (the fingerprint as signed long), key (of the row). No shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            found = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            keys = [row_key_of(i, t) for i, t in zip(batch.column(0).to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "fp", "key"])

    return map_arrow(docs.select(whole_id().alias("doc_id"), F.col("text").cast("string")), work, "doc_id bigint, fp bigint, key binary")


class Forest:
    """Union-find over 0..n-1 that remembers the links that joined two trees."""

    def __init__(self, n: int):
        self.parent, self.links = list(range(n)), []

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, pairs) -> None:
        for a, b in pairs:
            x, y = self.find(a), self.find(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.links.append((a, b))


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= DISTANCE


def forest(points: np.ndarray, free: int) -> list[tuple[int, int]]:
    """A spanning forest of distinct fingerprints (uint64, sorted) linked at DISTANCE, which agree outside mask free.

    Neighbours in sorted order are linked first. What is then outside the largest tree is compared with all; where
    that would be much, the points are first split by the pigeonhole again, over the free bits.
    """
    n, all_ = len(points), Forest(len(points))
    for step in range(1, min(n, 9)):
        near = np.flatnonzero(close(points[:-step], points[step:]))
        all_.join(zip(near.tolist(), (near + step).tolist(), strict=True))
    if n <= 9:
        return all_.links
    roots = np.array([all_.find(i) for i in range(n)])
    rest = np.flatnonzero(roots != np.bincount(roots).argmax())
    bits = [1 << i for i in range(64) if free >> i & 1]
    if len(rest) * n > 1 << 24 and len(bits) >= 2 * (DISTANCE + 1):
        for k in range(DISTANCE + 1):
            mask = sum(bits[k :: DISTANCE + 1])
            key = points & np.uint64(mask)
            order = np.lexsort((points, key))
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for part in np.split(order, cuts):
                if len(part) > 1:
                    all_.join((int(part[a]), int(part[b])) for a, b in forest(points[part], free & ~mask))
        return all_.links
    step = max(1, (1 << 22) // n)
    for i in range(0, len(rest), step):
        some = rest[i : i + step]
        a, b = np.nonzero(close(points[some][:, None], points[None, :]))
        a = some[a]
        unlike = roots[a] != roots[b]
        all_.join(zip(a[unlike].tolist(), b[unlike].tolist(), strict=True))
    return all_.links


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (choice, key, fp) sorted; a choice and key at a time."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [rows.shape[1]]))
        found = []
        for k in np.flatnonzero(ends - starts > 1).tolist():
            points = rows[2, starts[k] : ends[k]].view(np.uint64)
            points = np.sort(points)
            found += [points[list(pair)] for pair in forest(points, ~MASKS[rows[0, starts[k]]] & ((1 << 64) - 1))]
        if found:
            ends_ = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends_[:, 0]), pa.array(ends_[:, 1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        last = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
        cut_at = int(last[-1]) + 1 if len(last) else 0
        if cut_at:
            yield from links(np.concatenate([*held, rows[:, :cut_at]], axis=1))
            held = []
        elif held and (held[-1][0, -1] != rows[0, 0] or held[-1][1, -1] != rows[1, 0]):
            yield from links(np.concatenate(held, axis=1))
            held = []
        held.append(rows[:, cut_at:])
    if held:
        yield from links(np.concatenate(held, axis=1))


def links(distinct: DataFrame) -> DataFrame:
    """Verified links a, b between distinct fingerprints fp: for each key a spanning forest of its links."""
    keys = F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m))) for m in MASKS))
    keyed = distinct.select(F.posexplode(keys).alias("choice", "key"), "fp")
    keyed = keyed.repartition("choice", "key").sortWithinPartitions("choice", "key")
    return map_arrow(keyed, _verify, "a bigint, b bigint")


def grouped(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fp, key, and the row that its component leaves: first (no_id, doc_id, key)."""
    prints = staged(fingerprints(docs), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    distinct = cut(prints.groupBy("fp").agg(F.min(row).alias("first")))
    found = components(links(distinct.select("fp")))
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = cut(named)
    least = named.groupBy("component").agg(F.min("first").alias("first"))
    return prints.join(named.select("fp", "component").join(least, "component").select("fp", "first"), "fp")


def near_dedup(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fingerprint, component_id."""
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, with all its columns."""
    return leave(docs, grouped(docs).select("key", (F.col("key") == F.col("first.key")).alias("kept")))
