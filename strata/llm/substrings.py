"""Substring dedup: a log-structured index of window fingerprints.

A window is WINDOW consecutive words; a word goes if it stands in a window whose words also start anywhere else.
Windows are indexed by their anchor: the leftmost least hash of the GRAM-word sequences inside (winnowing, Schleimer et
al. 2003). Equal windows have equal anchors at equal offsets, and neighbouring windows mostly share one, so a row for
each anchor's stretch of windows stands for all of them, at about a tenth of the windows.

The index is a set of immutable runs: bucketed tables sorted by anchor hash, with a count and one place for each
distinct (anchor, stretch), in the shared folder. A new batch becomes a run; it is merge-joined with the historical run,
which needs no shuffle as both have the same buckets, and the join's outcome is the compacted run of the next level. An
anchor's stretches are dealt over PARTS buckets, so one frequent phrase in many contexts isn't in one task.

Verification is by digest of the very words: stretches whose words occur twice are duplicate windows throughout (64 bits
of anchor hash and 64 bits of XXH3 of all the words agree). Where stretches share an anchor but differ, their windows are compared
one by one by 96 bits of XXH3. Counts combine before each shuffle; places meet digests in joins that adaptive
execution may split, so a passage in a third of all documents isn't in one task.

Defined cases: null text has no words; texts under WINDOW words lose none; windows of repeated rows are each other's
copies; a null id (as one that isn't an integer) is a document like others; a text that repeats itself is judged like any other; other columns are
ignored; an empty table gives an empty result. Texts of any length are one sequence.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import delete, map_arrow, settings, shared_dir, staged, texts_of, whole_id

WINDOW, GRAM = 35, 12
SPAN = WINDOW - GRAM + 1
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Rows that a task combines before it passes them on.
COMBINE = 300_000
KEY = ["anchor", "digest"]
#: Buckets over which the stretches of one anchor are dealt.
PARTS = 32


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(h: np.ndarray) -> np.ndarray:
    """Hash of each GRAM consecutive numbers, by doubling."""
    runs, length, out, at, todo = h, 1, None, 0, GRAM
    while True:
        if todo & 1:
            if out is None:
                out, at = runs, length
            else:
                n = len(h) - at - length + 1
                out, at = mixed(out[:n] * ODD + runs[at : at + n]), at + length
        todo >>= 1
        if not todo:
            return out
        n = len(runs) - length
        runs, length = mixed(runs[:n] * ODD + runs[length : length + n]), length * 2


class Words:
    """The words of a text, joined by single spaces, with their byte positions."""

    def __init__(self, text: bytes):
        self.list = text.split()
        self.joined = b" ".join(self.list)
        self.ends = np.fromiter(map(len, self.list), np.int64, len(self.list)).cumsum() + np.arange(len(self.list))
        self.starts = np.concatenate(([0], self.ends[:-1] + 1))

    def digests(self, first: np.ndarray, last: np.ndarray) -> list[int]:
        """128 bits for each stretch of words, both ends included."""
        digest, joined = xxhash.xxh3_128_intdigest, self.joined
        return [digest(joined[a:b]) for a, b in zip(self.starts[first].tolist(), self.ends[last].tolist(), strict=True)]

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Anchor hash, first window, number of windows and digest of the words of each stretch."""
        h = np.fromiter(map(xxhash.xxh64_intdigest, self.list), np.uint64, len(self.list))
        grams = gram_hashes(h)
        n = len(self.list) - WINDOW + 1
        at = np.empty(n, np.int64)
        for i in range(0, n, 1 << 16):
            part = np.lib.stride_tricks.sliding_window_view(grams[i : i + (1 << 16) + SPAN - 1], SPAN)[: n - i]
            at[i : i + len(part)] = part.argmin(axis=1) + np.arange(i, i + len(part))
        anchors, first, counts = np.unique(at, return_index=True, return_counts=True)
        return grams[anchors].view(np.int64), first, counts, self.digests(first, first + counts + WINDOW - 2)


def keyed(docs: DataFrame) -> DataFrame:
    """id and salt tell documents apart, by 96 bits of hash of id and text: rows that agree in both are copies of one row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(whole_id(), text).alias("id"), F.hash(text).alias("salt"), whole_id().alias("doc_id"), text.alias("text"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for k, text in enumerate(texts_of(batch)):
            words = Words(text)
            if len(words.list) >= WINDOW:
                parts.append((k, *words.stretches()))
        if not parts:
            continue
        rows = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([p[1] for p in parts])),
                pa.array(np.array([x & ((1 << 64) - 1) for p in parts for x in p[4]], np.uint64).view(np.int64)),
                batch.column(0).take(pa.array(rows)),
                batch.column(1).take(pa.array(rows)),
                pa.array(np.concatenate([p[2] for p in parts]).astype(np.int32)),
                pa.array(np.concatenate([p[3] for p in parts]).astype(np.int32)),
            ],
            [*KEY, "id", "salt", "first", "n_windows"],
        )


def stretches(docs: DataFrame) -> DataFrame:
    """A row for each stretch of windows with one anchor. No shuffle."""
    return map_arrow(docs.select("id", "salt", "text"), _stretches, "anchor bigint, digest bigint, id bigint, salt int, first int, n_windows int")


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def emit() -> Iterator[pa.RecordBatch]:
        some = pa.Table.from_batches(held)
        anchor, digest = (some.column(c).to_numpy() for c in KEY)
        order = np.lexsort((digest, anchor))
        anchor, digest = anchor[order], digest[order]
        new = np.ones(len(order), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1])
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(order)))
        yield from some.take(pa.array(order[first])).append_column("n", pa.array(counts.astype(np.int64))).combine_chunks().to_batches(max_chunksize=50_000)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= COMBINE:
            yield from emit()
            held = []
    if held:
        yield from emit()


class Index:
    """Immutable sorted runs. add() takes a batch in and compacts; close() drops the tables."""

    def __init__(self, spark: SparkSession):
        self.spark, self.run, self.tables = spark, None, {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, run: DataFrame) -> str:
        name = f"window_run_{uuid.uuid4().hex}"
        self.tables[name] = shared_dir(self.spark, name)
        # Shuffle files of a run are of no use once it is written.
        with settings(self.spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
            run.write.bucketBy(self.buckets, "anchor", "part").sortBy("anchor").option("path", self.tables[name]).saveAsTable(name)
        return name

    def add(self, docs: DataFrame) -> None:
        """docs: id, salt, text. Their stretches become a run, merged with the historical run if there is one."""
        columns = "anchor bigint, digest bigint, id bigint, salt int, first int, n_windows int, n bigint"

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _combined(_stretches(batches))

        rows = map_arrow(docs.select("id", "salt", "text"), work, columns).withColumn("part", F.pmod("digest", F.lit(PARTS)).cast("byte")).repartition(self.buckets, "anchor", "part")
        place = F.min(F.struct("id", "salt", "first", "n_windows")).alias("place")
        new = rows.groupBy("anchor", "part", "digest").agg(F.sum("n").alias("n"), place).select(*KEY, "part", "n", "place.*")
        name = self._write(new)
        if self.run is None:
            self.run = name
            return
        old, new = self.spark.table(self.run).alias("o"), self.spark.table(name).alias("n")
        both = old.join(new, [*KEY, "part"], "full")
        either = [F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in ("id", "salt", "first", "n_windows")]
        merged = both.select(*KEY, "part", (F.coalesce("o.n", F.lit(0)) + F.coalesce("n.n", F.lit(0))).alias("n"), *either)
        former = [self.run, name]
        with settings(self.spark, spark__sql__requireAllClusterKeysForCoPartition="false"):
            self.run = self._write(merged)
        for gone in former:
            self._drop(gone)

    def read(self) -> DataFrame:
        return self.spark.table(self.run)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, self.tables.pop(name))

    def close(self) -> None:
        for name in list(self.tables):
            self._drop(name)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the windows of some stretches of each text."""
    for batch in batches:
        rows, starts, once, digests = [], [], [], []
        for k, (text, places) in enumerate(zip(texts_of(batch), batch.column(3).to_pylist(), strict=True)):
            words = Words(text)
            for p in places:
                first = np.arange(p["first"], p["first"] + p["n_windows"])
                digests += words.digests(first, first + WINDOW - 1)
                rows += [k] * len(first)
                starts += first.tolist()
                once += [p["once"]] * len(first)
                if len(rows) >= 200_000:
                    yield _window_rows(batch, rows, starts, once, digests)
                    rows, starts, once, digests = [], [], [], []
        if rows:
            yield _window_rows(batch, rows, starts, once, digests)


def _window_rows(batch: pa.RecordBatch, rows: list[int], starts: list[int], once: list[bool], digests: list[int]) -> pa.RecordBatch:
    a = np.array([x >> 64 for x in digests], np.uint64).view(np.int64)
    b = np.array([x & ((1 << 32) - 1) for x in digests], np.uint32).view(np.int32)
    take = pa.array(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(b), batch.column(0).take(take), batch.column(1).take(take), pa.array(starts, pa.int32()), pa.array(once)],
        ["a", "b", "id", "salt", "first", "once"],
    )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, places in zip(texts_of(batch), batch.column(2).to_pylist(), strict=True):
            words = text.split()
            if places:
                change = np.zeros(len(words) + 1, np.int64)
                for p in places:
                    change[p["first"]] += 1
                    change[p["first"] + p["n_windows"] + WINDOW - 1] -= 1
                stay = np.flatnonzero(change[:-1].cumsum() == 0).tolist()
            else:
                stay = range(len(words))
            n_words.append(len(words))
            n_removed.append(len(words) - len(stay))
            kept.append(b" ".join([words[i] for i in stay]).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def substring_dedup(docs: DataFrame, batches: int = 2) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (the words left, joined by one space)."""
    spark, docs = docs.sparkSession, keyed(docs)
    index = Index(spark)
    try:
        for k in range(batches):
            index.add(docs.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == k))
        runs = index.read()
        twice = staged(runs.where("n > 1").select(*KEY), "stretches")
        mixed_ = runs.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("anchor")
        every = mixed_.select("anchor", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<tinyint>")).alias("part"))
        places = runs.join(every, ["anchor", "part"]).select("id", "salt", F.struct("first", "n_windows", (F.col("n") == 1).alias("once")).alias("place"))
        places = staged(places, "places")
    finally:
        index.close()
    texts = docs.select("id", "salt", "text", "doc_id")
    wanted = places.groupBy("id", "salt").agg(F.collect_list("place").alias("places"))  # no more than a text has windows
    some = texts.join(wanted, ["id", "salt"]).select("id", "salt", "text", "places")
    windows = map_arrow(some, _windows, "a bigint, b int, id bigint, salt int, first int, once boolean")
    equal = windows.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    single = windows.where("once").join(equal, ["a", "b"]).select("id", "salt", "first", F.lit(1).alias("n_windows"))
    single = staged(single, "windows")
    whole = stretches(docs).join(twice, KEY).select("id", "salt", "first", "n_windows")
    gone = whole.unionAll(single).distinct().groupBy("id", "salt").agg(F.collect_list(F.struct("first", "n_windows")).alias("places"))
    judged = texts.join(gone, ["id", "salt"], "left").select("doc_id", "text", "places")
    return map_arrow(judged, _kept, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def digests(docs: DataFrame, batches: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return substring_dedup(docs, batches).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
