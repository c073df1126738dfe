"""The string kernel against enumeration, and held-out accuracy."""

import random
from itertools import combinations

import numpy as np

from strata.llm import toxicity as tox


def enumerated(s, t):
    total = 0.0
    for a in combinations(range(len(s)), tox.ORDER):
        for b in combinations(range(len(t)), tox.ORDER):
            if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                total += tox.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel_counts_gapped_subsequences():
    pick = random.Random(1)
    words = ["".join(pick.choices("abcd", k=pick.randint(0, 9))) for _ in range(40)] + [""]
    for landmark in ("abcda", "aabbcc", "dcbad"):
        got = tox.kernel(*tox.codes(words), tox.codes([landmark])[0][0])
        assert np.allclose(got, [enumerated(w, landmark) for w in words], rtol=1e-4)
    marks = tox.Landmarks(["abcda", "aabbcc", "dcbadb", "cabdabcd"] * 4)
    got = marks.similar(words)
    for w, row in zip(words, got, strict=True):
        want = [min(1, enumerated(w, t) / enumerated(t, t)) if common(w, t) >= max(tox.ORDER, 0.7 * len(t)) else 0 for t in marks.strings]
        assert np.count_nonzero(row) <= 1 and np.isclose(row.max(), max(want), atol=1e-4) and np.isclose(want[int(row.argmax())], row.max(), atol=1e-4)


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *(0 for _ in b)] if not row else [0, *np.maximum.accumulate([max(row[j + 1], row[j] + (x == y)) for j, y in enumerate(b)]).tolist()]
    return row[-1]


def test_long_words_are_whole(monkeypatch):
    pick = random.Random(2)
    words = ["".join(pick.choices("abcde", k=n)) for n in (3, 63, 64, 65, 130, 700)]
    marks = tox.Landmarks(["abcda", "ecbadb"])
    got = [tox.kernel(*tox.codes([w]), tox.codes(["ecbadb"])[0][0])[0] for w in words]
    similar = marks.similar([*words, "z" * 3000 + "ecxbadb" + "z" * 3000])
    monkeypatch.setattr(tox, "CHUNK", 1024)
    assert np.allclose(got, [tox.kernel(*tox.codes([w]), tox.codes(["ecbadb"])[0][0])[0] for w in words], rtol=1e-4)
    assert np.allclose(similar[:-1], marks.similar(words), atol=1e-4) and similar[-1, 1] >= 0.69


def corpus(n, seed):
    pick = random.Random(seed)
    stem = lambda: "".join(pick.choices(["an", "re", "th", "ou", "er", "st", "in", "ly"], k=pick.randint(1, 4)))
    out = []
    for i in range(n):
        toxic = pick.random() < 0.15
        words = [stem() for _ in range(pick.randint(5, 120))]
        for _ in range(pick.randint(2, 5) * toxic):
            words.insert(pick.randrange(len(words) + 1), pick.choice(["grobnik", "zukfald", "mip" + stem(), "Plodvex!"]))
        for k in range(7, len(words), 9):
            words[k] += "."
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_learns_and_tolerates_inserted_characters():
    rows = corpus(1500, 2)
    model = tox.train([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    new = corpus(600, 3)
    said = model.scores([t for _, t, _ in new]) >= tox.THRESHOLD
    truth = np.array([bool(y) for *_, y in new])
    assert (said & truth).sum() > 0.9 * truth.sum() and (said & ~truth).sum() < 0.02 * (~truth).sum()
    assert (model.scores(["an re grobxnik th", "you g r o b n i k", "zuk-fald", "zukf@ld here"]) >= tox.THRESHOLD).all()
    assert (model.scores(["", "an re th ouer stin", "x" * 5000]) < tox.THRESHOLD).all()
    for gap in ("k", "u", "-", "*", " "):
        found = [f"re {w[:i]}{gap}{w[i:]} an th" for w in ("grobnik", "zukfald", "plodvex") for i in range(1, len(w))]
        assert (model.scores(found) >= tox.THRESHOLD).mean() >= 0.9, gap
    assert (model.scores(["gr ob nik an", "Grob  nik", "g\nr\no\nb\nn\ni\nk"]) >= tox.THRESHOLD).all()
    assert (model.scores(["grob. nik an", "nik grob"]) < tox.THRESHOLD).all()


def test_few_documents_make_no_landmark():
    texts = [f"word{i % 7}x other{i % 11}y more{i % 13}z" for i in range(300)]
    toxic = np.arange(300) % 10 == 0
    for i in (10, 20, 30):
        texts[i] += " raretoken"
    assert tox.choose(texts, toxic) == []


def test_query_rows(spark):
    rows = corpus(400, 4)
    docs = spark.createDataFrame([*((i, t, 9, "x") for i, t, _ in rows), (None, None, 1, ""), (7, "", 1, ""), (7, "", 1, "")], "doc_id long, text string, toxic long, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = tox.fit(docs, labels)
    got = tox.score(docs, model).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id in (None,)}) == 1
    kept = tox.clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)
    bare = tox.fit(docs, labels.limit(0))
    assert {r.predicted for r in tox.score(docs, bare).collect()} == {0}
    assert tox.score(docs.limit(0), model).count() == 0
    assert tox.score(docs, tox.fit(docs.limit(0), labels)).where("predicted = 1").count() == 0
    # Labels of held-out rows change nothing.
    flipped = labels.withColumn("toxic", tox.F.when(tox.held_out(), 1 - tox.F.col("toxic")).otherwise(tox.F.col("toxic")))
    again = tox.fit(docs, flipped)
    assert again.landmarks == model.landmarks and np.allclose(again.weights, model.weights)
