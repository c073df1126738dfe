"""Seeds and alignment against full alignment of every document with every item."""

import random

from strata.llm import decontaminate as dec


def brute(item, passage):
    """Smith-Waterman over word lists."""
    rows, best = [[0] * (len(passage) + 1)], 0
    for a in item:
        row = [0]
        for j, b in enumerate(passage):
            row.append(max(0, rows[-1][j] + (dec.MATCH if a == b else dec.MISMATCH), rows[-1][j + 1] - dec.GAP, row[j] - dec.GAP))
        rows.append(row)
        best = max(best, *row)
    return best


def make(pick, n):
    return ["w%d" % min(int(pick.expovariate(0.02)), 400) for _ in range(n)]


def test_against_full_alignment(spark):
    pick = random.Random(8)
    items = [(k, make(pick, pick.randint(12, 40))) for k in range(12)] + [(20, ["Alpha", "beta"]), (21, ["Single-"]), (22, []), (23, None)]
    items.append((24, items[0][1]))
    docs = []
    for i in range(120):
        body = make(pick, pick.randint(0, 300))
        if i % 3 == 0:
            item = list(items[i % 12][1])
            for _ in range(pick.randint(0, len(item) // 6)):
                item[pick.randrange(len(item))] = "edit%d" % pick.randrange(9)
            if pick.random() < 0.3:
                del item[pick.randrange(len(item))]
            at = pick.randint(0, len(body))
            body[at:at] = [w.upper() + "!!" for w in item] if i % 2 else item
        docs.append((i, " ".join(body)))
    docs += [(500, None), (501, ""), (502, "x ALPHA, beta y"), (503, " ".join(items[3][1]) * 2), (503, " ".join(items[3][1]) * 2), (None, " ".join(items[5][1])), (504, "word " * 30_000 + "alpha beta")]
    texts = [(i, None if t is None else " ".join(t)) for i, t in items]
    frame = spark.createDataFrame([(i, t, 0.5, "s") for i, t in docs], "doc_id long, text string, score double, item_id string").repartition(3)
    bench = spark.createDataFrame([(i, t, 1) for i, t in texts], "item_id long, text string, doc_id int")
    want = []
    for d, t in docs:
        for i, item in texts:
            a, b = dec.words(item), dec.words(t)
            if a and b and len(b) < 2000 and (score := brute(a, b) / (dec.MATCH * len(a))) >= dec.THRESHOLD:
                want.append((str(d), i, round(score, 9)))
    want += [("504", 20, 1.0)]
    for limit in (dec.SLICE, 600):
        got = [(str(r.doc_id), r.item_id, round(r.score, 9)) for r in dec.matches(frame, bench, limit=limit).collect()]
        assert sorted(got) == sorted(want)
    assert len(want) > 40
    for limit in (dec.SLICE, 600, 100):  # 100: items longer than a slice
        clean = dec.clean(frame, bench, limit=limit)
        assert clean.columns == frame.columns
        leaked = {d for d, *_ in want}
        assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in docs if str(i) not in leaked)
    assert sorted((str(r.doc_id), r.item_id, round(r.score, 9)) for r in dec.matches(frame, bench, limit=100).collect()) == sorted(want)
    assert dec.matches(frame, bench.limit(0)).count() == 0 and dec.matches(frame.limit(0), bench).count() == 0


def test_rows_are_judged_by_their_own_text(spark):
    item = " ".join("leak%d" % i for i in range(20))
    rows = [(1, item, "a", 1), (1, "clean words here", "b", 2), (None, item, "c", 3), (None, "other words", "d", 4), (2, item + " x", None, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _leaked string, item_id long")
    left = dec.clean(frame, spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert left.columns == frame.columns and sorted(r["_leaked"] for r in left.collect()) == ["b", "d"]
    named = frame.withColumn("doc_id", dec.F.lit("no number"))
    assert dec.clean(named, spark.createDataFrame([(9, item)], "item_id long, text string")).count() == 2


def test_dense_edits_against_full_alignment(spark):
    """15 to 50 % of the words replaced, dropped or pushed apart, evenly or not, in one copy and in many."""
    pick = random.Random(21)
    items = [(k, make(pick, 30) if k % 2 else ["own%d_%d" % (k, i) for i in range(pick.randint(20, 40))]) for k in range(16)]
    items += [(30, ["the", "of"] * 10), (31, ["one", "two", "three"])]
    docs = [(1000 + i, make(pick, 150)) for i in range(40)] + [(2000, ["a1", "a2"] * 40)]
    for k, item in items:
        for every in (2, 3, 4, 5, 6):
            replaced = ["x%d" % i if i % every == every - 1 else w for i, w in enumerate(item)]
            dropped = [w for i, w in enumerate(item) if i % every != every - 1]
            apart = [w for i, v in enumerate(item) for w in ([v, "y%d" % i] if every == 2 or i % every else [v])]
            some = [w if pick.random() > 0.3 else "z%d" % i for i, w in enumerate(item)]
            for body in (replaced, dropped, apart, some):
                docs.append((len(docs), make(pick, 20) + body + make(pick, 20)))
    hot = [w if i % 5 < 4 else "h%d" % i for i, w in enumerate(items[2][1])]
    docs += [(5000 + i, make(pick, 10) + hot) for i in range(300)]
    texts = [(i, " ".join(t)) for i, t in items]
    want = []
    for d, t in docs:
        for i, item in texts:
            a, b = dec.words(item), dec.words(" ".join(t))
            if (score := brute(a, b) / (dec.MATCH * len(a))) >= dec.THRESHOLD:
                want.append((d, i, round(score, 9)))
    frame = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string").repartition(3)
    got = dec.matches(frame, spark.createDataFrame(texts, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in got.collect()) == sorted(want)
    assert len(want) > 500 and {d for d, i, _ in want if i == 2} >= set(range(5000, 5300))
