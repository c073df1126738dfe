"""Archives against direct computation."""

import hashlib
import random
from base64 import b32encode

import pytest

from strata.llm import warc


def test_loser_tree_merges():
    pick = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(((f"u{pick.randrange(9)}", "t", pick.choice([None, 1, 2]), 0, "", "", None, f"f{j}", i, 0) for i in range(pick.randint(0, 20))), key=warc.order) for j in range(k)]
        got = list(warc.LoserTree([iter(r) for r in runs]))
        assert got == sorted((x for r in runs for x in r), key=warc.order)


def brute(rows, least):
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        same = [i for i, _, h in rows if (h or "") == (html or "") and i is not None]
        first = min(same, default=None) if len(raw) >= least else None
        again = first is not None and first != page_id
        out.append((page_id, len(raw), b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("most", [warc.REVISITS_BROADCAST, 0])
def test_round_trip(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(warc, "REVISITS_BROADCAST", most)
    rows = [(5, "http://b.com/x y", "<p>é</p>"), (2, "http://a.com/2\r\nX: y", "<p>é</p>"), (9, None, None), (7, "http://a.com/", ""), (3, "https://a.com/1?q#f", "x\r\n\r\nWARC/1.1\r\n" * 3)]
    rows += [(2, "http://a.com/2", "<p>é</p>"), (None, "u", "<p>é</p>"), (None, "u", "solo"), (11, "http://c.org", "long " * 60_000), (12, "http://z.org", "😀")]
    rows += [(100 + i, f"http://h{i % 7}.com/{i}", f"page {i % 11}") for i in range(60)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, file string, n_bytes int").repartition(3)
    for least in (0, 7):
        got = warc.archive(frame, least)
        assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got.collect()) == brute(rows, least)
        keys = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in got.collect()]
        assert keys == sorted(keys)
    path = f"file://{tmp_path}/archive"
    warc.write(frame, path, file_bytes=160 << 10)
    files = [p for p in (tmp_path / "archive").iterdir() if p.name.startswith("part-")]
    assert len(files) >= 7 and max(p.stat().st_size for p in files) < 350_000
    found = [r for p in files for r in warc.parse(p.read_bytes())]
    assert len(found) == len(rows) and all(f["warc-record-id"].startswith("<urn:uuid:") for _, _, f, _ in found)
    assert warc.archive(frame.limit(0)).count() == 0


def test_files_are_bounded_by_bytes(spark, tmp_path):
    """Pages of 1 MB among small ones; a page larger than a file is alone in it."""
    rows = [(i, f"http://h{i}.com/", chr(97 + i % 26) * (1 << 20)) for i in range(60)] + [(100 + i, f"http://s{i}.com/", f"small {i}") for i in range(500)] + [(900, "http://big.com", "z" * (9 << 20))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = f"file://{tmp_path}/archive"
    warc.write(frame, path, file_bytes=8 << 20)
    sizes = sorted(p.stat().st_size for p in (tmp_path / "archive").iterdir() if p.name.startswith("part-"))
    assert 9 << 20 < sizes[-1] < (9 << 20) + 2000 and sizes[-2] < (8 << 20) + 10_000
    got = warc.read_index(spark, path).collect()
    assert len(got) == 561 and sorted(r.page_id for r in got) == sorted(r[0] for r in rows) and sum(r.record_type == "revisit" for r in got) == 34
