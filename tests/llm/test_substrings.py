"""Substring dedup against counting all windows."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import xxhash

from strata.llm import substrings as sub


def brute(rows):
    words = [[w for w in (t or "").translate({c: " " for c in range(9, 14)}).split(" ") if w] for _, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(doc_id), len(w), len(gone), sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_gram_hashes_depend_on_their_numbers_only():
    x = np.random.default_rng(1).integers(0, 2**63, 100, dtype=np.uint64)
    y = np.concatenate([x[40:60], x])
    assert (sub.gram_hashes(x)[40:49] == sub.gram_hashes(y)[:9]).all()
    assert len(sub.gram_hashes(x)) == 100 - sub.GRAM + 1 and len(set(sub.gram_hashes(x).tolist())) == 89


def test_against_brute_force(spark):
    pick = random.Random(9)
    some = lambda n, v=60: [f"w{pick.randrange(v)}" for _ in range(n)]
    passages = [some(n) for n in (20, 34, 35, 36, 50, 90)]
    rows = []
    for i in range(80):
        words = some(pick.randint(0, 150))
        for _ in range(pick.randint(0, 2)):
            at, p = pick.randint(0, len(words)), list(pick.choice(passages))
            if pick.random() < 0.4:
                p[pick.randrange(len(p))] = "edited"
            words[at:at] = p
        rows.append((i, pick.choice([" ", "\n", "\t ", "\x0b"]).join(words)))
    rows += [(200, rows[5][1]), (201, None), (202, ""), (203, "same " * 200), (204, " ".join(["a b c"] * 60)), (205, "once " * 34), (206, "q " * 35), (207, "z " * 36)]
    rows += [(3, rows[3][1]), (4, " ".join(some(70))), (None, rows[7][1]), (None, " ".join(some(80))), (208, "é\xa0ß " * 40)]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, id int, n_words int").repartition(3)
    want = brute(rows)
    for batches in (1, 3):
        got = sub.digests(frame, batches).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == want
    assert sum(n > 0 for _, _, n, _ in want) > 40
    assert sub.digests(frame.limit(0)).count() == 0


def test_one_phrase_in_many_contexts_and_rows_without_id(spark):
    """A frequent anchor with a context of its own in each document; its rows lie in many buckets, and settings stay."""
    pick = random.Random(5)
    least = lambda words: int(sub.gram_hashes(np.array([xxhash.xxh64_intdigest(w.encode()) for w in words], np.uint64)).min())
    phrase = next(p for k in range(10**5) if least(p := [f"hot{k}-{i}" for i in range(14)]) < 1 << 55)  # an anchor wherever it stands
    rows = [(None if i % 3 else 7, " ".join([f"a{pick.randrange(10**9)}" for _ in range(30)] + phrase + [f"b{pick.randrange(10**9)}" for _ in range(30)])) for i in range(400)]
    rows += [(None, rows[5][1]), (8, rows[6][1] + " tail"), (None, "short text")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")}
    got = sub.digests(frame).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute(rows)
    assert {k: spark.conf.get(k, None) for k in before} == before
    index = sub.Index(spark)
    index.add(sub.keyed(frame))
    parts = index.read().groupBy("anchor").agg(sub.F.countDistinct("part").alias("n"), sub.F.count("*").alias("rows")).orderBy(sub.F.desc("rows")).first()
    assert parts.rows > 300 and parts.n == sub.PARTS
    index.close()
    named = frame.withColumn("doc_id", sub.F.lit("name"))
    assert sum(r.n_removed > 0 for r in sub.digests(named).collect()) == sum(n > 0 for _, _, n, _ in brute(rows))
