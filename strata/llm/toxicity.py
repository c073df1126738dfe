"""Toxicity: a support vector machine over Nystroem features of a gap-weighted subsequence string kernel.

kernel(s, t) sums decay**(span in s + span in t) over all common subsequences of ORDER characters (Lodhi et al. 2002),
divided by kernel(t, t) and capped at 1 for a landmark t, so a word that holds an insult with one character inserted
keeps DECAY of its similarity at least. A word is coded by its nearest landmark, under the inverse square root of the
landmarks' own kernel matrix (Nystroem). A sentence, and so a document, is as toxic as its most toxic word: the machine is
linear over words and learns from those of labelled documents: words of toxic documents that come near a landmark are
positive, words of clean ones that do are negative; each landmark with one more character inside is positive too. A
fitted logistic curve over labelled documents turns the margin into a probability.

Landmarks are word beginnings that toxic documents hold more often than chance allows: the bound is on the probability of
such a count among as many documents, over all beginnings tried, so neither a few documents nor label noise make one.

Words are lower-cased, lose signs at their ends and inside (a sign between letters is a gap that costs nothing) and read
digits that stand for letters as letters. Runs of four or more single characters are also read as one word, and
neighbouring words that spell a landmark together are also read as one, with a gap where the first ends.

Learning reads at most `rows` labelled documents and `characters` of their texts, chosen by a hash of the id, without
those held out. Scoring reads every word of every document in place, without a shuffle.

Defined cases: null and empty texts hold no word and get the score of a text without any similarity; a null id
is never held out; other columns, `labels` among them, are ignored; without both kinds of label every score is the
share of toxic labels (0 without labels); repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from math import ceil, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import map_arrow, whole_id

ORDER, DECAY, LANDMARKS, LONGEST = 5, 0.7, 64, 12
#: Stands before each word and landmark, so a beginning counts as a character.
START = "^"
ROWS, CHARACTERS = 8000, 32_000_000
THRESHOLD = 0.3
COST = 10.0
#: Toxic words, and as much again their gapped forms, weigh this part of the clean ones.
BALANCE = 8
#: A word is compared with a landmark if a common subsequence has so much of the landmark's characters; below, similarity is small.
SHARED = 0.7
#: A word of a toxic document that is so similar to a landmark is positive.
SURE = 0.9
#: A word of a clean document that is so similar to one is negative; others lie with a word without any similarity.
UNSURE = 0.3
#: Chance of any landmark by luck alone, over all word beginnings that are tried.
LUCK = 0.05
#: Least share of toxic documents among those that hold a landmark.
PURE = 0.9
#: Positions of words that the kernel takes at a time; what reaches over is carried on, so words of any length are whole.
CHUNK = 64
#: Characters of a batch of words, and of the remembered words of a reader (an entry counts as 100 more).
CELLS, MEMO = 1 << 20, 30_000_000
#: Digits and signs that stand for letters.
STANDS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
SINGLES = re.compile(r"(?<!\S)\S(?:\s+\S){3,}(?!\S)")
ENDING = ".!?"
SIGNS = re.compile(r"[\W_]+")
ENDS = re.compile(r"^[\W_]+|[\W_]+$")


def plain(word: str) -> str:
    """The letters of a word behind START; nothing if it has none."""
    word = word.lower()
    if not word.isalpha():
        word = ENDS.sub("", word)
        if not word.isalpha():
            word = SIGNS.sub("", word.translate(STANDS)) if any(c.isalpha() for c in word) else ""
    return START + word if word else ""


def kernel(words: np.ndarray, lengths: np.ndarray, landmark: np.ndarray) -> np.ndarray:
    """Raw kernel of many words (a matrix of character codes, 0 is padding) with one landmark."""
    width, m, square = words.shape[1], len(landmark), np.float32(DECAY**2)
    decayed = lambda n: np.tril(DECAY ** np.subtract.outer(np.arange(n), np.arange(n)).clip(0)).astype(np.float32)
    along_word, along_landmark = decayed(min(width, CHUNK)), decayed(m).T
    fade = (DECAY ** np.arange(1, CHUNK + 1)).astype(np.float32)[:, None]
    held = [np.zeros((len(words), m), np.float32)] * (ORDER - 1)  # of each order, by the position before the chunk
    total = np.zeros(len(words))
    for a in range(0, width, CHUNK):
        part = words[:, a : a + CHUNK]
        n = part.shape[1]
        hit = (part[:, :, None] == landmark) & (np.arange(a, a + n) < lengths[:, None])[:, :, None]
        gain = hit * square
        for k in range(ORDER - 1):
            ways = along_word[:n, :n] @ (gain @ along_landmark)  # of one order, by the ends in word and landmark
            if a:
                ways += fade[:n] * held[k][:, None]
            gain = np.zeros_like(gain)
            gain[:, 1:, 1:] = hit[:, 1:, 1:] * ways[:, :-1, :-1] * square
            gain[:, 0, 1:] = hit[:, 0, 1:] * held[k][:, :-1] * square
            held[k] = ways[:, -1]
        total += gain.sum(axis=(1, 2), dtype=float)
    return total


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    width = max(map(len, words), default=1) or 1
    joined = "".join(w.ljust(width, "\0") for w in words)
    return np.frombuffer(joined.encode("utf-32-le"), "<u4").reshape(len(words), width), np.array([len(w) for w in words])


class Landmarks:
    """Similarity of words to each landmark: 0 for words that share less than SHARED of its characters in order.

    Those are found first by a bit-parallel longest common subsequence (Hyyroe 2004), several landmarks to a 64-bit
    number, so the kernel runs on the few pairs that are left.
    """

    def __init__(self, strings: list[str]):
        self.strings = strings
        self.own = [float(kernel(*codes([s]), codes([s])[0][0])[0]) for s in strings]
        self.lanes, lane, used = [], [], 0
        for k, s in enumerate(strings):
            if used + len(s) + 1 > 63:
                self.lanes.append(lane)
                lane, used = [], 0
            lane.append((k, used, len(s)))
            used += len(s) + 1  # a free bit above each landmark takes its carry
        if lane:
            self.lanes.append(lane)

    def near(self, words: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each landmark the words with a common subsequence of ORDER characters and SHARED of the landmark's."""
        alphabet, index = np.unique(words, return_inverse=True)
        index = index.reshape(words.shape)
        for lane in self.lanes:
            masks = np.zeros(len(alphabet), np.uint64)
            full = 0
            for k, start, n in lane:
                full |= ((1 << n) - 1) << start
                for i, c in enumerate(self.strings[k]):
                    masks[alphabet == ord(c)] |= np.uint64(1 << (start + i))
            full = np.uint64(full)
            rows = np.full(len(words), full, np.uint64)
            if words.shape[1] <= 8 * CHUNK:
                for i in range(words.shape[1]):
                    hit = rows & masks[index[:, i]]
                    rows = ((rows + hit) | (rows - hit)) & full
            else:  # few long words, one by one
                numbers, whole = masks.tolist(), int(full)
                for k, word in enumerate(index):
                    left = whole
                    for c in filter(None, map(numbers.__getitem__, word.tolist())):
                        hit = left & c
                        left = ((left + hit) | (left - hit)) & whole
                    rows[k] = left
            for k, start, n in lane:
                mask = np.uint64(((1 << n) - 1) << start)
                common = n - np.bitwise_count(rows & mask).astype(np.int64)
                yield k, np.flatnonzero(common >= max(ORDER, ceil(SHARED * n)))

    def similar(self, words: list[str]) -> np.ndarray:
        """A row for each word, a column for each landmark: the similarity to the nearest one, 0 to the others."""
        out = np.zeros((len(words), len(self.strings)), np.float32)
        order = np.argsort([len(w) for w in words], kind="stable")
        start = 0
        while start < len(order):
            end = min(len(order), start + 20_000)
            while end - start > 1 and len(words[order[end - 1]]) * (end - start) > CELLS:
                end = (start + end) // 2
            part = order[start:end]
            start = end
            matrix, lengths = codes([words[k] for k in part])
            for k, rows in self.near(matrix, lengths):
                landmark = codes([self.strings[k]])[0][0]
                for j in range(0, len(rows), 2000):
                    some = rows[j : j + 2000]
                    out[part[some], k] = np.minimum(1, kernel(matrix[some], lengths[some], landmark) / self.own[k])
        # Words that only share a beginning with a family of landmarks would add up to as much as one of the family.
        nearest = np.zeros_like(out)
        if out.size:
            at = (np.arange(len(out)), out.argmax(axis=1))
            nearest[at] = out[at]
        return nearest

    def split_words(self) -> tuple[set[str], set[str], set[str]]:
        """Proper beginnings, middles and ends of landmarks: what their parts are where white space splits them."""
        bodies = [s[1:] for s in self.strings]
        begins = {b[:i] for b in bodies for i in range(1, len(b))}
        return begins, {b[i:j] for b in bodies for i in range(1, len(b)) for j in range(i + 1, len(b))}, {b[i:] for b in bodies for i in range(1, len(b))}

    def joined(self, words: list[str], at: int, stop: int) -> str | None:
        """The words from `at` on as one with a gap, if they spell a landmark, whatever follows in the last of them."""
        first = plain(words[at])[1:]
        for s in self.strings:
            rest, i, parts = s[1 + len(first) :], at, []
            if not s.startswith(START + first) or not rest:
                continue
            while i + 1 < stop and words[i][-1] not in ENDING:
                i += 1
                body = plain(words[i])[1:]
                parts.append(body)
                if body.startswith(rest):
                    return START + first + " " + "".join(parts)
                if not body or not rest.startswith(body):
                    break
                rest = rest[len(body) :]
        return None


def words_of(text: str) -> list[str]:
    """The words of a text in order; a run of single characters is followed by one word of all of them."""
    if SINGLES.search(text):
        text = SINGLES.sub(lambda m: m[0] + " " + re.sub(r"\s", "", m[0]), text)
    return text.split()


class Reader:
    """Turns texts into the sentences that have any similarity, remembering distinct words."""

    def __init__(self, landmarks: Landmarks, memo: int = MEMO):
        self.landmarks, self.most = landmarks, memo
        self.begins, self.middles, self.ends = landmarks.split_words()
        self.longest = max(map(len, self.ends), default=0)
        self.clear()

    def clear(self) -> None:
        """Codes of words: row of the similarity matrix, then 4 if it may go on a split landmark, 2 if begin one, 1 if a sentence ends."""
        self.memo: dict[str, int] = {}
        self.rows = [np.zeros((1, len(self.landmarks.strings)), np.float32)]
        self.size, self.held = 1, 0

    def _rows(self, strings: list[str]) -> list[int]:
        """Rows of the similarity matrix, 0 for none."""
        values = self.landmarks.similar(strings)
        some = values.any(axis=1)
        where = np.where(some, self.size - 1 + some.cumsum(), 0)
        self.rows.append(values[some])
        self.size += int(some.sum())
        return where.tolist()

    def _part(self, word: str) -> int:
        if not word:
            return 0
        goes_on = word in self.middles or any(word[:k] in self.ends for k in range(1, min(len(word), self.longest) + 1))
        return 4 * goes_on + 2 * (word in self.begins)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of self.rows[0] for the words with any similarity, and the text that each is from."""
        words = [words_of(t) for t in texts]
        if self.held > self.most:
            self.clear()
        new = list(set().union(*words).difference(self.memo))
        if new:
            read = [plain(w) for w in new]
            distinct = list(set(read))
            at = {p: row << 3 | self._part(p[1:]) for p, row in zip(distinct, self._rows(distinct), strict=True)}
            self.memo.update((w, at[p] | (w[-1] in ENDING)) for w, p in zip(new, read, strict=True))
            self.held += 100 * len(new) + sum(map(len, new))
        counts = np.array([len(w) for w in words], np.int64)
        flat = list(chain.from_iterable(words))
        all_ = np.fromiter(map(self.memo.__getitem__, flat), np.int64, len(flat))
        of = np.repeat(np.arange(len(texts)), counts)
        ends = (all_ & 1).astype(bool)
        ends[counts.cumsum()[counts > 0] - 1] = True
        sentence = np.concatenate(([0], ends.cumsum()[:-1])) if len(ends) else np.zeros(0, np.int64)
        hit = np.flatnonzero(all_ >> 3)
        rows = all_[hit] >> 3
        begins = np.flatnonzero((all_[:-1] & 2 > 0) & (all_[1:] & 4 > 0) & (sentence[:-1] == sentence[1:]))
        if len(begins):
            stops = counts.cumsum()
            found = [(j, x) for j in begins.tolist() if (x := self.landmarks.joined(flat, j, int(stops[of[j]])))]
            fresh = list({x for _, x in found}.difference(self.memo))
            self.memo.update(zip(fresh, (r << 3 for r in self._rows(fresh)), strict=True))
            self.held += sum(100 + len(x) for x in fresh)
            hit = np.concatenate([hit, np.array([j for j, _ in found], np.int64)])
            rows = np.concatenate([rows, np.array([self.memo[x] >> 3 for _, x in found], np.int64)])
        if len(self.rows) > 1:
            self.rows = [np.concatenate(self.rows)]
        return rows[rows > 0], of[hit[rows > 0]]


def choose(texts: list[str], toxic: np.ndarray) -> list[str]:
    """Landmarks: word beginnings that toxic documents hold more often than chance allows, chosen to cover those documents."""
    copies: tuple[set, set] = (set(), set())
    known: dict[str, tuple[str, ...]] = {}  # a word as it stands: its beginnings that count

    def parts(label: bool, among: Counter = Counter()) -> Iterator[set[str]]:
        for text in (t for t, y in zip(texts, toxic, strict=True) if y == label):
            read = words_of(text)
            least = min((crc32(f"{a} {b}".encode()) for a, b in zip(read, read[1:], strict=False)), default=-1)
            if least in copies[label]:  # what only copies of one document share doesn't mark anything
                continue
            copies[label].add(least)
            read = set(read)
            for word in read.difference(known):
                w = plain(word)
                known[word] = tuple(x for k in range(ORDER, min(len(w), LONGEST) + 1) if (x := w[:k]) in among or not among)
            yield set().union(*map(known.__getitem__, read))

    marked = Counter(s for d in parts(True) for s in d)
    marked = Counter({s: c for s, c in marked.items() if c > 2})
    known.clear()
    copies[1].clear()
    docs = list(parts(True, marked))
    clean = Counter(s for d in parts(False, marked) for s in d)
    share = len(docs) / max(1, len(docs) + len(copies[0]))
    needed = log(max(1, len(marked)) / LUCK)

    def beyond_luck(c: int, n: int) -> bool:
        """Chernoff's bound on c toxic documents or more among the n that hold a string."""
        p = c / n
        return p >= max(PURE, share) and n * (p * log(p / share) + (0 if p == 1 else (1 - p) * log((1 - p) / (1 - share)))) > needed

    strong = {s for s, c in marked.items() if beyond_luck(c, c + clean[s])}
    docs = [d & strong for d in docs]
    open_, out = docs, []
    while len(out) < LANDMARKS:
        cover = Counter(s for d in open_ for s in d)
        if not cover:
            break
        most = max(cover.values())
        # Of beginnings that cover about as many, the one that clean texts have least, then the longest.
        best = max((s for s, c in cover.items() if c >= 0.85 * most), key=lambda s: (-clean[s], cover[s] >= 0.98 * most, len(s), cover[s], s))
        out.append(best)
        gone = {s for s in strong if s.startswith(best) or best.startswith(s)}
        strong -= gone
        docs = [d - gone for d in docs]
        left = [d - gone for d in open_ if best not in d]
        # Documents have several insults: once each has a landmark, look for others that are as frequent.
        open_ = left if any(left) else docs
    return out


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # of similarities: the machine's weights under the Nystroem map
    bias: float
    slope: float
    offset: float

    def __post_init__(self):
        self.reader = Reader(Landmarks(self.landmarks))
        self.known = np.zeros(0)

    def __reduce__(self):
        return Model, (self.landmarks, self.weights, self.bias, self.slope, self.offset)

    def margins(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        rows, of = self.reader.words(texts)
        if len(rows):
            if len(self.known) != len(self.reader.rows[0]):
                self.known = self.reader.rows[0] @ self.weights + self.bias
            np.maximum.at(out, of, self.known[rows])
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.offset, -50, 50)))


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = COST) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    penalty = np.eye(x1.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(50):
        active = y * (x1 @ w) < 1
        a = x1[active] * weight[active, None]
        new = np.linalg.solve(penalty + cost * a.T @ x1[active], cost * a.T @ y[active])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Platt's slope and offset."""
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    target = np.where(label, (label.sum() + 1) / (label.sum() + 2), 1 / ((~label).sum() + 2))
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def train(texts: list[str], toxic: np.ndarray) -> Model:
    toxic = np.asarray(toxic, bool)
    constant = float(toxic.mean()) if len(toxic) else 0.0
    chosen = choose(texts, toxic) if 0 < toxic.sum() < len(toxic) else []
    if not chosen:
        return Model([], np.zeros(0), 0.0, 1e-3, float(np.log((constant + 1e-9) / (1 - constant + 1e-9))))
    landmarks = Landmarks(chosen)
    own = landmarks.similar(chosen).astype(float)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    root = vectors @ np.diag(np.maximum(values, 1e-3) ** -0.5) @ vectors.T  # Nystroem: features are similarities @ root
    reader = Reader(landmarks, memo=2**62)  # the training texts are bounded
    parts = [reader.words(texts[i : i + 500]) for i in range(0, len(texts), 500)]
    rows = np.concatenate([p[0] for p in parts])
    of = np.concatenate([p[1] + 500 * i for i, p in enumerate(parts)])
    values = reader.rows[0]
    del reader, parts

    def examples(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that differ, and a weight that grows slowly with how often each occurs."""
        different, counts = np.unique(rows[some], return_counts=True)
        return values[different] @ root, 1 + np.log(counts)

    near = values.max(axis=1)[rows]
    positive, p_weight = examples(toxic[of] & (near >= SURE))
    negative, n_weight = examples(~toxic[of] & (near >= UNSURE))
    negative, n_weight = np.vstack([negative, np.zeros((1, len(chosen)))]), np.append(n_weight, 1.0)
    # Each landmark with one more character inside is a positive example too.
    inserted = [landmarks.similar([s[:i] + " " + s[i:] for i in range(2, len(s))]) for s in chosen]
    gapped = np.vstack(inserted) @ root
    g_weight = np.concatenate([np.full(len(x), 1 / len(x)) for x in inserted])
    even = n_weight.sum() / BALANCE
    x = np.vstack([positive, gapped, negative])
    y = np.concatenate([np.ones(len(positive) + len(gapped)), -np.ones(len(negative))])
    weight = np.concatenate([p_weight * even / max(1, p_weight.sum()), g_weight * even / g_weight.sum(), n_weight])
    w, bias = machine(x, y, weight)
    weights = root @ w
    margins = np.full(len(texts), bias)
    np.maximum.at(margins, of, (values @ weights + bias)[rows])
    varied = np.vstack([x[len(x) // 2] for x in inserted]) @ weights + bias
    slope, offset = logistic(np.append(margins, varied), np.append(toxic, np.ones(len(varied), bool)))
    return Model(chosen, weights, bias, slope, offset)


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learnt: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, characters: int = CHARACTERS) -> Model:
    """Learn from at most `rows` labelled documents with at most `characters` of text in all."""
    labels = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    labels = labels.where(F.col("_toxic").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id"))
    order = (F.xxhash64("_id"), F.col("_id"))
    chosen = labels.groupBy("_id").agg(F.max("_toxic").alias("_toxic")).orderBy(*order).limit(rows)
    found = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id")
    texts, toxic, read = [], [], 0
    for row in found.select(*order, "_id", "_text", "_toxic").orderBy(*order, F.xxhash64("_text")).toLocalIterator():
        read += len(row["_text"])
        if read > characters and texts:
            break
        texts.append(row["_text"])
        toxic.append(row["_toxic"] == 1)
    return train(texts, np.array(toxic, bool))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LANDMARKS short strings and their weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = own.scores([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = map_arrow(docs.select(whole_id().alias("doc_id"), F.col("text").cast("string")), work, "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns. Rows are judged in place."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = own.scores([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(scores < threshold))

    return map_arrow(docs, work, docs.schema)
