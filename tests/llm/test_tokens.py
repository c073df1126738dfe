"""Byte-level BPE against the tiktoken library."""

import hashlib
import random
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from strata.llm import bpe
from strata.llm.queries import tokenizer


@pytest.fixture(scope="module")
def both():
    own = tokenizer()
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


CASES = ["", " ", "a", "it's we'LL I'd", "  two  spaces ", "tab\tand\n\n line \r\n end ", "é ñ ß 　 \xa0x", "日本語 テキスト", "🙂🙂 x", "<|endoftext|>", "1234567 12.5", "a\x1c b", "\x00\x00"]


def test_matches_library(both):
    own, library = both
    pick = random.Random(5)
    texts = CASES + ["".join(pick.choices("abcdeé tehi'ñ1.\n", k=k)) for k in (3, 30, 300, 3000)] + ["a" * 5000, "".join(pick.choices("etaoin", k=6000)), "日本語の文章です" * 200]
    texts += ["".join(map(chr, pick.choices(range(0x4E00, 0x9FA5), k=3000))), "".join(pick.choices("これは日本語東京大", k=2000)) + " x " + "é" * 700, "".join(pick.choices("0123456789abcdefABCDEF+/=_-", k=9000)), bytes(pick.choices(range(1, 128), k=4000)).decode(), "".join(map(chr, pick.choices(range(0x1F300, 0x1F600), k=900)))]
    for text, ids in zip(texts, own.encode(texts, bpe.Memo()), strict=True):
        assert ids == np.array(library.encode_ordinary(text), "<u4").tobytes(), text[:40]
        assert own.decode(ids) == text.encode()


def test_memo_never_changes_a_result(both, monkeypatch):
    own, _ = both
    monkeypatch.setattr(bpe, "MEMO", 3)
    memo = bpe.Memo()
    texts = ["one two three four", "two two five", "", "one"]
    assert own.encode(texts, memo) + own.encode(texts[::-1], memo)[::-1] == own.encode(texts, bpe.Memo()) * 2


def test_unspaced_text_costs_as_much_a_byte_and_memory_is_bounded(both, monkeypatch):
    own, _ = both
    pick = random.Random(7)
    spaced = [" ".join("".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(700)) for _ in range(40)]
    unspaced = ["".join(map(chr, pick.choices(range(0x4E00, 0x9FA5), k=1870))) for _ in range(40)]
    own.encode(CASES + unspaced[:1], bpe.Memo())
    taken = []
    for texts in (spaced, unspaced):
        began = time.process_time()
        own.encode(texts, bpe.Memo())
        taken.append((time.process_time() - began) / sum(len(t.encode()) for t in texts))
    print(f"seconds a MB: spaced {taken[0] * 1e6:.2f}, unspaced {taken[1] * 1e6:.2f}")
    assert taken[1] < 2 * taken[0]
    monkeypatch.setattr(bpe, "MEMO", 1 << 20)
    memo = bpe.Memo()
    tracemalloc.start()
    for k in range(0, 40, 2):
        own.encode(spaced[k : k + 2] + unspaced[k : k + 2], memo)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert memo.held < 3 << 20 and peak < 60 << 20
    assert not [k for k in memo if len(k) > bpe.REMEMBERED]


def test_other_patterns_are_split_by_themselves():
    own = tokenizer(pattern=r"[a-z ]+|\s|.")
    library = tiktoken.Encoding("other", pat_str=own.pattern, mergeable_ranks=own.ranks, special_tokens={})
    texts = ["one two  three X y\nz", "", "日本 a b c d" * 40]
    memo = bpe.Memo()
    for _ in range(2):
        assert own.encode(texts, memo) == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts]


def test_query_rows(spark, both):
    own, library = both
    rows = [(1, "Hello  world", 7), (2, None, 8), (3, "", 9), (3, "x" * 400, 1), (None, "it's", 2)]
    got = bpe.round_trip(spark, spark.createDataFrame(rows, "doc_id long, text string, n_tokens long"), own).collect()
    want = sorted(
        (str(i), len(ids := library.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t, _ in rows
    )
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == want
    apart = bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, n_tokens long"), own), own).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in apart) == sorted((str(i), (t or "").encode()) for i, t, _ in rows)
    empty = bpe.round_trip(spark, spark.createDataFrame([], "doc_id long, text string"), own)
    assert empty.count() == 0
