"""Benchmark decontamination: seeds that no alignment can avoid, then Smith-Waterman alignment of words.

Words are runs of letters and digits, lower-cased. An item's features are its words and its pairs of neighbouring words,
by place. An alignment of m words in r runs scores at most MATCH * m - (r - 1), and holds m words and m - r pairs, so one
that reaches the threshold holds at least `need` features. All but the need - 1 commonest are the item's seeds: whatever
was edited and however often it leaked, one of them stands in each such passage. A first pass counts the features in the
corpus, which only tells common from rare ones (partial counts by task, then one row for each). A second pass finds seeds
in each document, drops pairs of document and item (then passages) that share fewer than `need` features, and aligns the
passages around the seeds with the item; the local alignment's score, as a share of the score of the whole item, tells
copies, edited copies and paraphrases that keep enough words. Nothing else is left out: the result is that of full alignment.

Test items are read in slices of at most SLICE characters, each sent to every executor; a larger benchmark takes more
slices, each of two passes over the corpus, never a larger broadcast; only an item that is longer than that by itself makes
a slice of its own. Documents aren't shuffled and each is read whole.

Defined cases: null or wordless texts match nothing, on either side; an item of one or two words is found as a
whole only; equal items each match; repeated document rows each get their rows; a null doc_id or item_id (as one that isn't an integer) is carried as null;
clean() judges each row by its own text in place;
other columns are ignored; an empty table on either side gives no matches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import map_arrow, whole_id

GRAM, THRESHOLD, SLICE, CELLS = 2, 0.5, 8_000_000, 8_000_000
MATCH, MISMATCH, GAP = 2, -1, 1
WORDS = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def alignment(item: np.ndarray, passage: np.ndarray) -> int:
    """Score of the best local alignment. 0 stands for a word that the items don't have and matches nothing."""
    steps = np.arange(len(passage) + 1, dtype=np.int64) * GAP
    row, best = np.zeros(len(passage) + 1, np.int64), 0
    for word in item:
        score = np.where((passage == word) & (passage > 0), MATCH, MISMATCH)
        new = np.maximum(row - GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + score)
        row = np.maximum(np.maximum.accumulate(new + steps) - steps, 0)
        best = max(best, int(row.max()))
    return best


def need(n: int, threshold: float) -> int:
    """So many of its 2n - 1 features an item of n words shares with a passage that reaches the threshold, at least."""
    return 2 * n - 1 if n <= 2 else max(1, math.ceil(MATCH * n * threshold - 1 - 1e-9))


class Index:
    """Words and pairs of words of a slice of test items. Feature w - 1 is word w, then come the pairs."""

    def __init__(self, items: list[tuple[int | None, str | None]], threshold: float = THRESHOLD):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.items = [np.array([number(w) for w in words(t)], np.int64) for _, t in items]
        self.base = len(self.vocabulary) + 1
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(self.pair(item) for item in self.items)]))
        self.size = len(self.vocabulary) + len(self.pairs)
        self.needs = np.array([need(len(item), threshold) for item in self.items], np.int64)
        # Features of all items by place, words of an item first: item, feature, place.
        self.lengths = np.array([max(2 * len(item) - 1, 0) for item in self.items], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        none = np.zeros(0, np.int64)
        self.features = np.concatenate([none, *(x for item in self.items for x in (item - 1, self.named(self.pair(item))))])
        self.places = np.concatenate([none, *(np.arange(n) for item in self.items for n in (len(item), max(len(item) - 1, 0)))])

    def pair(self, numbers: np.ndarray) -> np.ndarray:
        return numbers[:-1] * self.base + numbers[1:]

    def named(self, pairs: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.pairs, pairs) + self.base - 1

    def seed(self, counts: np.ndarray) -> None:
        """Take all features of each item but its need - 1 commonest as seeds."""
        owner = np.repeat(np.arange(len(self.items)), self.lengths)
        order = np.lexsort((-counts[self.features], owner))
        rank = np.arange(len(owner)) - self.begins[owner]
        chosen = np.sort(order[rank >= self.needs[owner] - 1])
        self.own = np.searchsorted(chosen, self.begins)  # where the seeds of each item begin
        self.seeds, self.at = self.features[chosen], self.places[chosen]
        pairs = np.unique(np.stack([self.seeds, owner[chosen]]), axis=1)
        self.of, self.first = pairs[1], np.searchsorted(pairs[0], np.arange(self.size + 1))

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, each followed by GRAM zeros, and where each begins."""
        get, parts, starts, at = self.vocabulary.get, [], [], 0
        for t in texts:
            found = [get(w, 0) for w in words(t)]
            starts.append(at)
            parts += [*found, *[0] * GRAM]
            at += len(found) + GRAM
        return np.array(parts, np.int64), np.array([*starts, at], np.int64)

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and features found there."""
        where = np.flatnonzero(numbers)
        two = np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0))
        if not len(self.pairs):
            return where, numbers[where] - 1
        own = numbers[two] * self.base + numbers[two + 1]
        slot = np.minimum(np.searchsorted(self.pairs, own), len(self.pairs) - 1)
        found = self.pairs[slot] == own
        return np.concatenate([where, two[found]]), np.concatenate([numbers[where] - 1, slot[found] + self.base - 1])

    def count(self, texts: list[str | None]) -> np.ndarray:
        return np.bincount(self.hits(self.numbers(texts)[0])[1], minlength=self.size)

    def matches(self, texts: list[str | None], threshold: float) -> Iterator[tuple[int, int, float, int]]:
        """Text, item, share of the item's score, and the passage's first word."""
        step = max(1, CELLS // max(self.size, 1))
        for low in range(0, len(texts), step):
            for text, *found in self._matches(texts[low : low + step], threshold):
                yield low + text, *found

    def _matches(self, texts: list[str | None], threshold: float) -> Iterator[tuple[int, int, float, int]]:
        numbers, starts = self.numbers(texts)
        at, feature = self.hits(numbers)
        if not len(at):
            return
        text = np.searchsorted(starts, at, "right") - 1
        present = np.zeros((len(texts), self.size), bool)
        present[text, feature] = True
        t, f = np.nonzero(present & (np.diff(self.first) > 0))
        many = self.first[f + 1] - self.first[f]
        slot = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[f], many)
        pairs = np.unique(np.repeat(t, many) * len(self.items) + self.of[slot])
        t, k = pairs // len(self.items), pairs % len(self.items)
        keep = np.zeros(len(pairs), bool)
        size = 1 + CELLS // max(int(self.lengths.max()), 1)
        for low in range(0, len(pairs), size):
            a, b = t[low : low + size], k[low : low + size]
            n = self.lengths[b]
            ends = np.cumsum(n)
            slot = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(self.begins[b], n)
            shared = np.add.reduceat(present[np.repeat(a, n), self.features[slot]].astype(np.int64), ends - n)
            keep[low : low + size] = shared >= self.needs[b]
        t, k = t[keep], k[keep]
        if not len(t):
            return
        order = np.lexsort((at, text))
        at, feature = at[order], feature[order]
        bounds = np.searchsorted(text[order], np.arange(len(texts) + 1))
        for text, k in zip(t.tolist(), k.tolist(), strict=True):
            item, here = self.items[k], slice(bounds[text], bounds[text + 1])
            whole, n = MATCH * len(item), len(item)
            slack = max(int(MATCH * n * (1 - threshold)) // GAP, 0) + 1  # a passage that scores has no more words of its own
            best = (0.0, 0)
            for low, high in self.spans(k, at[here], feature[here], slack, int(starts[text]), int(starts[text + 1]) - GRAM):
                passage = numbers[low:high]
                shared = int(np.isin(item, passage).sum() + np.isin(self.pair(item), self.pair(passage)).sum())
                if shared >= self.needs[k]:
                    best = max(best, (alignment(item, passage) / whole, int(starts[text]) - low))
            if best[0] >= threshold:
                yield text, k, best[0], int(-best[1])

    def spans(self, k: int, at: np.ndarray, feature: np.ndarray, slack: int, begin: int, end: int) -> Iterator[tuple[int, int]]:
        """Passages around the seeds of item k; those that meet are one."""
        seeds, places = self.seeds[self.own[k] : self.own[k + 1]], self.at[self.own[k] : self.own[k + 1]]
        names = np.unique(seeds)
        slot = np.minimum(np.searchsorted(names, feature), len(names) - 1)
        hit = names[slot] == feature
        at, slot = at[hit], slot[hit]
        # The last place of a seed reaches furthest left, the first furthest right.
        last, first = np.zeros(len(names), np.int64), np.full(len(names), len(self.items[k]), np.int64)
        np.maximum.at(last, np.searchsorted(names, seeds), places)
        np.minimum.at(first, np.searchsorted(names, seeds), places)
        lows = np.maximum(at - last[slot] - slack, begin)
        highs = np.minimum(at - first[slot] + len(self.items[k]) + slack, end)
        order = np.argsort(lows, kind="stable")
        lows, highs = lows[order], np.maximum.accumulate(highs[order])
        new = np.flatnonzero(lows[1:] > highs[:-1]) + 1
        yield from zip(lows[[0, *new]].tolist(), highs[[*(new - 1), -1]].tolist(), strict=True)


def slices(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in lists of about `limit` characters at most, by a hash of the text; null texts are left out."""
    items = benchmark.select(whole_id("item_id").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    long, length = F.length("text") > limit, F.coalesce(F.sum(F.when(F.length("text") <= limit, F.length("text"))), F.lit(0))
    size, n_long = items.agg(length, F.count(F.when(long, 1))).first()
    n = max(1, -(-2 * size // limit) if size > limit else 1)
    parts = [F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == k for k in range(n)] if n > 1 else [F.lit(True)]
    for part in parts:
        if rows := [(r.item_id, r.text) for r in items.where(~long & part).collect()]:
            yield rows
    if n_long:  # each of these alone is over the limit
        for r in items.where(long).select(F.xxhash64("text", "item_id").alias("h")).distinct().collect():
            yield [(x.item_id, x.text) for x in items.where(long & (F.xxhash64("text", "item_id") == r.h)).collect()]


def indexes(docs: DataFrame, benchmark: DataFrame, threshold: float, limit: int) -> Iterator:
    """Broadcast indexes of the slices, each with seeds chosen by counts over all of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    for items in slices(benchmark, limit):
        index = Index(items, threshold)
        if not index.size:
            continue
        shared = spark.sparkContext.broadcast(index)  # of SLICE characters, or one item

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            total = np.zeros(own.size, np.int64)
            for batch in batches:
                total += own.count(batch.column(0).to_pylist())
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])

        counted = map_arrow(texts, count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
        got, counts = counted.toArrow(), np.zeros(index.size, np.int64)  # as many rows as the slice has features, whatever the corpus
        counts[got["gram"].to_numpy()] = got["n"].to_numpy()
        index.seed(counts)
        shared.destroy()
        yield spark.sparkContext.broadcast(index)


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, limit: int = SLICE) -> DataFrame:
    """A row for each document and test item that align: doc_id, item_id, score (0 to 1), first_word."""
    rows, out = docs.select(whole_id().alias("doc_id"), F.col("text").cast("string").alias("text")), None
    for seeds in indexes(docs, benchmark, threshold, limit):

        def align(batches: Iterator[pa.RecordBatch], seeds=seeds) -> Iterator[pa.RecordBatch]:
            own = seeds.value
            for batch in batches:
                found = list(own.matches(batch.column(1).to_pylist(), threshold))
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                columns = [pa.array([own.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "item_id", "score", "first_word"])

        part = map_arrow(rows, align, "doc_id bigint, item_id bigint, score double, first_word bigint")
        out = part if out is None else out.unionAll(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, score double, first_word bigint")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, limit: int = SLICE) -> DataFrame:
    """The rows of docs whose text aligns with no test item, with all their columns. Rows are judged in place."""
    at, out = docs.columns.index("text"), docs
    for seeds in indexes(docs, benchmark, threshold, limit):

        def keep(batches: Iterator[pa.RecordBatch], seeds=seeds) -> Iterator[pa.RecordBatch]:
            own = seeds.value
            for batch in batches:
                stay = np.ones(batch.num_rows, bool)
                stay[[f[0] for f in own.matches(batch.column(at).to_pylist(), threshold)]] = False
                yield batch.filter(pa.array(stay))

        out = map_arrow(out, keep, docs.schema)
    return out
