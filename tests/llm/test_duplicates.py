"""Exact, near and substring duplicates against brute force."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import xxhash
from pyspark.sql import functions as F

from strata.llm import exact_dedup, simhash
from strata.llm.common import components, row_key_of

SCHEMA = "doc_id long, text string, component long, fp string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(3)


def prose(pick, n, vocabulary=200):
    return " ".join("".join(pick.choices("abcdefg", k=pick.randint(1, 6))) if pick.random() < 0.2 else f"w{pick.randrange(vocabulary)}" for _ in range(n))


def test_trie_with_and_without_spill():
    pick = random.Random(2)
    keys = ["".join(pick.choices("ab", k=pick.randint(0, 12))).encode() for _ in range(2000)]
    keys += [b"shared" * 50 + k for k in keys[:500]]
    want = Counter(keys)
    for limit in (1 << 40, 3000, 0):
        trie = exact_dedup.Trie(lambda a, b: (a[0], a[1] + b[1]), limit)
        for k in keys:
            trie.insert(k, (k, 1))
        got = list(trie.values())
        assert len(got) == len(want) and dict(got) == want


def test_exact_dedup(spark):
    rows = [(5, "a b\tc"), (2, "abc"), (9, "abc "), (3, "ab c "), (4, None), (1, " \n"), (7, ""), (8, "é" * 5000), (6, "é" * 5000), (10, "\xa0"), (None, "abc"), (11, "x"), (11, "x"), (None, "solo"), (None, "solo"), (11, "own"), (5, "a bc"), (12, "p q"), (12, "p\tq")]
    want = []
    key = lambda t: (t or "").translate({c: None for c in (32, *range(9, 14))})
    for i, t in rows:
        group = [(-len(u or ""), j is None, j or 0, row_key_of(j, (u or "").encode()), j) for j, u in rows if key(u) == key(t)]
        *_, best, keep = min(group)
        want.append((i, keep, len(group), best == row_key_of(i, (t or "").encode()), sha256(key(t).encode()).hexdigest()))
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    stay = exact_dedup.deduplicate(frame(spark, rows))
    assert stay.columns == ["doc_id", "text", "component", "fp"]
    assert sorted(map(str, (r.doc_id for r in stay.collect()))) == sorted({str((i, text)): str(i) for i, _, _, k, text in want if k}.values())
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_rows_that_share_an_id_keep_their_own_verdict(spark):
    """Ids that repeat or lack, columns named like inner ones, rows equal in all columns, a group of copies without id."""
    rows = [(1, "one text", "a", [1]), (1, "two text", "b", [2]), (2, "one text", "c", None), (None, "one  text", "d", None), (None, "three", "e", [3]), (None, "three", "e", [3]), (3, "four", "f", []), (3, "four", "g", [])]
    rows += [(None, "hot copy", "h", [k]) for k in range(300)] + [(None, None, None, None), (4, "", "i", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _key string, _dropped array<long>").withColumn("kept", F.create_map(F.lit("a"), F.col("doc_id"))).repartition(5)
    for deduplicate in (exact_dedup.deduplicate, simhash.deduplicate):
        left = deduplicate(frame)
        assert left.columns == frame.columns
        got = sorted(str((r.doc_id, r.text)) for r in left.collect())
        assert got == sorted(map(str, [(None, "one  text") if deduplicate is exact_dedup.deduplicate else (1, "one text"), (1, "two text"), (None, "three"), (3, "four"), (None, "hot copy"), (4, "")]))
    texts = frame.withColumn("doc_id", F.concat(F.lit("id-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("x"))))
    assert exact_dedup.deduplicate(texts).count() == 6 and exact_dedup.deduplicate(texts).dtypes == texts.dtypes


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                m = min(parent[a], parent[b])
                if (parent[a] != m or parent[b] != m) and linked(a, b):
                    parent[a] = parent[b] = m
                    changed = True
    return parent


def test_near_dedup(spark):
    pick = random.Random(3)
    base = prose(pick, 150).split()
    texts = ["", None, "one", "ONE", "two words", "É x y z", "é x y z", "Ab\x0bcd  ef\tgh"]
    for _ in range(60):
        words = list(base)
        for _ in range(pick.randint(0, 3)):
            words[pick.randrange(len(words))] = "edit%d" % pick.randrange(50)
        texts.append(" ".join(words))
    texts += [prose(pick, 80) for _ in range(40)]
    rows = list(enumerate(texts, 10))
    prints = {i: brute_fingerprint(t) for i, t in rows}
    want = brute_components([i for i, _ in rows], lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = simhash.near_dedup(frame(spark, rows)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i, _ in rows}
    assert len(set(want.values())) < len(rows) - 20
    stay = simhash.deduplicate(frame(spark, rows))
    assert stay.columns == ["doc_id", "text", "component", "fp"] and {r.doc_id for r in stay.collect()} == set(want.values())
    assert simhash.near_dedup(frame(spark, [])).count() == 0


def test_forest_joins_what_is_close():
    pick = random.Random(4)
    points = set()
    for _ in range(30):
        centre = pick.getrandbits(64)
        for _ in range(pick.randint(1, 60)):
            p = centre
            for _ in range(pick.randint(0, 5)):
                p ^= 1 << pick.randrange(32)
            points.add(p)
    points = np.array(sorted(points), np.uint64)
    for low in (1 << 24, 0):
        simhash_forest = simhash.Forest(len(points))
        simhash_forest.join(simhash.forest(points, (1 << 32) - 1))
        brute = simhash.Forest(len(points))
        brute.join((a, b) for a in range(len(points)) for b in range(a) if int(points[a] ^ points[b]).bit_count() <= 3)
        assert [simhash_forest.find(i) for i in range(len(points))] == [brute.find(i) for i in range(len(points))]


def test_components(spark):
    pick = random.Random(6)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7), (None, 3)]
    parent = simhash.Forest(500)
    parent.join((a, b) for a, b in edges if a is not None)
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: parent.find(x) for x in nodes}
