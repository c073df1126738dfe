"""The pipeline, stage by stage, against brute force."""

import random

import numpy as np
import public_tokenizers
import tiktoken
from test_decontaminate import brute as align
from test_duplicates import brute_components, brute_fingerprint

import corpus_pipeline
from strata.llm import decontaminate, queries, toxicity


def test_each_stage_on_its_input(spark, tmp_path):
    pick = random.Random(12)
    word = lambda: "".join(pick.choices(["an", "re", "th", "ou", "er", "st", "in", "ly", "mo", "ka"], k=pick.randint(1, 4)))
    items = [" ".join(word() for _ in range(25)) for _ in range(6)]
    docs, labels = [], []
    for i in range(260):
        words = [word() for _ in range(pick.randint(30, 120))]
        toxic = i % 6 == 0
        for _ in range(4 * toxic):
            words.insert(pick.randrange(len(words)), pick.choice(["grobnik", "zukfald", "plodvex"]))
        if i % 17 == 0:
            words[10:10] = items[i % 6].split()
        docs.append([i, " ".join(words)])
        labels.append((i, 1, int(toxic)))
    docs += [[300 + i, docs[7 * i + 1][1] + " " * (i % 3)] for i in range(12)]
    docs += [[400 + i, docs[5 * i + 3][1] + " tail"] for i in range(12)] + [[500, None], [501, ""]]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    model = toxicity.fit(read("documents"), read("labels"))
    kept = {i: t for i, t in docs if model.scores([t or ""])[0] < 0.3}
    stages = [set(kept)]
    key = lambda t: "".join((t or "").split(" "))
    kept = {i: t for i, t in kept.items() if i == min((-len(u or ""), j) for j, u in kept.items() if key(u) == key(t))[1]}
    stages.append(set(kept))
    prints = {i: brute_fingerprint(t) for i, t in kept.items()}
    of = brute_components(list(kept), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    kept = {i: t for i, t in kept.items() if of[i] == i}
    stages.append(set(kept))
    words = decontaminate.words
    leaks = lambda t: any(align(words(x), words(t)) >= 0.5 * 2 * len(words(x)) for x in items)
    kept = {i: t for i, t in kept.items() if not leaks(t)}
    stages.append(set(kept))
    assert all(len(a) > len(b) for a, b in zip([dict(docs), *stages], stages, strict=False)) and len(stages[-1]) > 150

    frame = read("documents")
    for (_, stage), want in zip(corpus_pipeline.STAGES[:-1], stages, strict=True):
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r.doc_id for r in frame.collect()} == want
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=queries.tokenizer().ranks, special_tokens={})
    got = {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: np.array(library.encode_ordinary(t or ""), "<u4").tobytes() for i, t in kept.items()}
