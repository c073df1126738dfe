"""Exact dedup: Patricia-trie owners.

Texts are compared without the characters [\x20\x09-\x0D]. Each task first enters its rows into a local radix trie, so
a group of copies of any size leaves a task as few rows; those are dealt by length and content hash, and the owner of
a partition enters full byte strings into a compressed radix trie whose terminal nodes hold the best row and the
count. A trie over its memory bound writes its largest subtree to a temporary file of the task and reads it when the
rest is done. Rows then meet their class by (length, SHA-256), a join that adaptive execution may split by rows, so a
group with a third of all rows isn't in one task.

Defined cases: null text counts as empty, and empty texts are equal; of equal texts the row of most code points in the
original, then smallest id, stays; null ids come last; of rows that agree in that too the one of the smallest hash of id
and text stays, and rows that repeat id and text are one document and share its verdict (deduplicate() leaves one of
them); ids that aren't integers count as null; other columns are ignored; an empty table gives an empty result. A text of any length is one key.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import SPACES, leave, map_arrow, row_key_of, texts_of, whole_id

#: Bytes of keys in a task's local trie before it is emptied, and in an owner's trie before a subtree is spilled.
LOCAL_BYTES, OWNER_BYTES = 16 << 20, 64 << 20


def common_prefix(a: bytes, b: bytes, start: int) -> int:
    """How many bytes of a are at b[start:]. Halving over slices compares at memcmp speed."""
    low, high = 0, min(len(a), len(b) - start)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[start + low : start + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Compressed radix trie of byte strings; merge(old, new) combines the values of equal keys.

    Over `limit` bytes of labels the largest subtree below the root is moved to a temporary file, as are later keys
    that belong to it. items() reads the spilled subtrees one by one, splitting each at the end of what its keys share.
    """

    def __init__(self, merge: Callable, limit: int, prefix: bytes = b""):
        self.merge, self.limit, self.prefix = merge, limit, prefix  # every key begins with the prefix
        self.children: dict[int, list] = {}  # first byte: [label, children, value]
        self.value = None
        self.bytes: dict[int, int] = {}
        self.files: dict = {}

    def size(self) -> int:
        return sum(self.bytes.values())

    def insert(self, key: bytes, value) -> None:
        at = len(self.prefix)
        if at == len(key):
            self.value = value if self.value is None else self.merge(self.value, value)
            return
        top = key[at]
        if top in self.files:
            pickle.dump((key, value), self.files[top])
            return
        children = self.children
        while True:
            node = children.get(key[at])
            if node is None:
                children[key[at]] = [key[at:], None, value]
                self.bytes[top] = self.bytes.get(top, 0) + len(key) - at + 200
                break
            label = node[0]
            if not key.startswith(label, at):
                n = common_prefix(label, key, at)
                children[key[at]] = fork = [label[:n], {label[n]: [label[n:], node[1], node[2]]}, None]
                self.bytes[top] += 300
                node = fork
            at += len(node[0])
            if at == len(key):
                node[2] = value if node[2] is None else self.merge(node[2], value)
                break
            if node[1] is None:
                node[1] = {}
            children = node[1]
        while self.size() > self.limit:
            self.spill(max(self.bytes, key=self.bytes.get))

    def spill(self, top: int) -> None:
        self.files[top] = file = tempfile.TemporaryFile()  # gone with the task, whatever ends it
        for key, value in self._walk(self.children.pop(top)):
            pickle.dump((key, value), file)
        del self.bytes[top]

    def _walk(self, top: list) -> Iterator[tuple[bytes, object]]:
        stack = [(top, self.prefix)]
        while stack:
            (label, children, value), prefix = stack.pop()
            key = prefix + label
            if value is not None:
                yield key, value
            stack += [(x, key) for x in (children or {}).values()]

    def values(self) -> Iterator:
        """The merged value of each distinct key."""
        if self.value is not None:
            yield self.value
        for top in list(self.children):
            for _, value in self._walk(self.children.pop(top)):
                yield value
        for file in self.files.values():
            yield from self._values_of(file)

    def _values_of(self, file) -> Iterator:
        first, shared = None, 0
        for key, _ in self._entries(file):
            if first is None:
                first, shared = key, len(key)
            else:
                shared = common_prefix(first[:shared], key, 0)
        part = Trie(self.merge, self.limit, (first or b"")[:shared])
        for key, value in self._entries(file):
            part.insert(key, value)
        file.close()
        yield from part.values()

    @staticmethod
    def _entries(file) -> Iterator[tuple[bytes, object]]:
        file.seek(0)
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


def best(old: tuple, new: tuple) -> tuple:
    """Values: (-code points, id is null, id, row key, rows, digest). The smaller stays; rows add up."""
    return (*min(old[:4], new[:4]), old[4] + new[4], old[5])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, bytes, bytes]]:
    for batch in batches:
        for doc_id, raw in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
            yield doc_id, len(raw.decode()), raw.translate(None, SPACES), row_key_of(doc_id, raw)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(_rows([batch]))
        digests = [hashlib.sha256(key).digest() for _, _, key, _ in rows]
        lengths = pa.array([len(key) for _, _, key, _ in rows], pa.int64())
        own = pa.array([r[3] for r in rows], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), lengths, pa.array(digests, pa.binary()), own], ["doc_id", "n_bytes", "digest", "row_key"])


KEYED = ["n_bytes", "hash", "digest", "key", "points", "best_id", "best_key", "n_rows"]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct texts of a task, with the best row and the number of rows of each."""

    def emptied(trie: Trie) -> Iterator[pa.RecordBatch]:
        found = [key_value for top in trie.children.values() for key_value in trie._walk(top)]
        if trie.value is not None:
            found.append((b"", trie.value))
        for i in range(0, len(found), 500):
            part = found[i : i + 500]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([len(k) for k, _ in part], pa.int64()),
                    pa.array([int.from_bytes(v[5][:8], "little", signed=True) for _, v in part], pa.int64()),
                    pa.array([v[5] for _, v in part], pa.binary()),
                    pa.array([k for k, _ in part], pa.binary()),
                    pa.array([-v[0] for _, v in part], pa.int64()),
                    pa.array([v[2] if not v[1] else None for _, v in part], pa.int64()),
                    pa.array([v[3] for _, v in part], pa.binary()),
                    pa.array([v[4] for _, v in part], pa.int64()),
                ],
                KEYED,
            )

    trie = Trie(best, 1 << 62)
    for doc_id, points, key, row in _rows(batches):
        trie.insert(key, (-points, doc_id is None, doc_id or 0, row, 1, hashlib.sha256(key).digest()))
        if trie.size() > LOCAL_BYTES:
            yield from emptied(trie)
            trie = Trie(best, 1 << 62)
    yield from emptied(trie)


def _owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes of one partition of (length, content hash)."""
    trie = Trie(best, OWNER_BYTES)
    for batch in batches:
        for n_bytes, _, digest, key, points, doc_id, row, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            trie.insert(key, (-points, doc_id is None, doc_id or 0, row, rows, (n_bytes, digest)))
    values = trie.values()
    while part := [v for _, v in zip(range(5000), values)]:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([v[5][0] for v in part], pa.int64()),
                pa.array([v[5][1] for v in part], pa.binary()),
                pa.array([None if v[1] else v[2] for v in part], pa.int64()),
                pa.array([v[3] for v in part], pa.binary()),
                pa.array([v[4] for v in part], pa.int64()),
            ],
            ["n_bytes", "digest", "keep_id", "keep_key", "group_size"],
        )


def classes(docs: DataFrame) -> DataFrame:
    """n_bytes, digest, keep_id, keep_key, group_size: a row for each distinct text."""
    docs = docs.select(whole_id().alias("doc_id"), F.col("text").cast("string"))
    local = map_arrow(docs, _local, "n_bytes bigint, hash bigint, digest binary, key binary, points bigint, best_id bigint, best_key binary, n_rows bigint")
    return map_arrow(local.repartition("n_bytes", "hash"), _owner, "n_bytes bigint, digest binary, keep_id bigint, keep_key binary, group_size bigint")


def judged(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, digest, row_key, keep_id, group_size, kept."""
    members = map_arrow(
        docs.select(whole_id().alias("doc_id"), F.col("text").cast("string")), _members, "doc_id bigint, n_bytes bigint, digest binary, row_key binary"
    )
    return members.join(classes(docs), ["n_bytes", "digest"]).withColumn("kept", F.col("row_key") == F.col("keep_key"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    return judged(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of docs for each distinct text, with all its columns."""
    return leave(docs, judged(docs).select(F.col("row_key").alias("key"), "kept"))
