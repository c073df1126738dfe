"""Minimum cuts against enumeration, and page texts."""

import random
import re
import time
from itertools import product

import duckdb

from strata.llm import html_text as ht


def test_minimum_cut_is_least():
    pick = random.Random(3)
    for _ in range(60):
        n = pick.randint(1, 8)
        source = [max(0, pick.randint(-4, 6)) for _ in range(n)]
        sink = [0 if s else pick.randint(0, 6) for s in source]
        edges = [(a, b, pick.randint(0, 3)) for a in range(n) for b in range(a) if pick.random() < 0.5]
        cost = lambda keep: sum(t if k else s for k, s, t in zip(keep, source, sink, strict=True)) + sum(c for a, b, c in edges if keep[a] != keep[b])  # noqa: E731, B023
        assert cost(ht.minimum_cut(source, sink, edges)) == min(cost(k) for k in product([False, True], repeat=n))


PROSE = "The river rose in the night and by morning the lower fields were under water. "


def test_templates():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p><p>no';</script></head><body>"
        "<header><h2>Site name</h2></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><!-- <p>no</p> -->"
        f"<div class='ad'>Buy now. {PROSE}</div><article><h1>Flood &amp; rain</h1><p><b>{PROSE}<br><p>It&#39;s \n\n caf&eacute;&nbsp;time.</p>"
        f"<blockquote>{PROSE}</blockquote><section id=comments><p>{PROSE} says Bob</p></section></article>"
        f"<aside><p>{PROSE}</p></aside><form><label>Mail</label><input><button>Go</button></form><footer>&copy; x &middot; {PROSE}</footer>"
    )
    p = PROSE.strip()
    assert ht.main_text(page) == f"Flood & rain {p} It's café time. {p}"
    plain = f"<body><div id=menu><a href=1>Home</a> <a href=2>News</a></div><div class=content><p>{PROSE}</p><p>{PROSE}</p></div><div class='cookie-notice'>{PROSE}</div></body>"
    assert ht.main_text(plain) == f"{p} {p}"
    assert ht.main_text(None) == ht.main_text("") == ht.main_text("<nav>x</nav>") == ""
    assert ht.main_text("a < b and <i>c</i>d " + PROSE) == ("a < b and cd " + p)
    assert ht.main_text("<article><p title='a > b'>One two three.</p></article>") == "One two three."
    many = "<article>" + "<p>Some words here.</p>" * 5000 + "<nav>" + "<a href=x>y</a>" * 5000
    assert ht.main_text(many) == " ".join(["Some words here."] * 5000)
    assert len(ht.main_text("<div" * 20_000)) >= 0 and len(ht.main_text('<a href="' * 20_000)) >= 0


def soup(pick):
    """A page without any telling name, and its blocks with what they are."""
    word = lambda: "".join(pick.choices(["an", "re", "th", "ou", "er", "st", "in", "ly"], k=pick.randint(1, 3)))
    words = lambda a, b: " ".join(word() for _ in range(pick.randint(a, b)))
    out: list[tuple[str, bool]] = []

    def block(text, keep, tag="p"):
        out.append((" ".join(text.split()), keep))
        return f"<{tag}>{text}</{tag}>"

    links = lambda n: "".join(block(f"<a href=x>{words(1, 3)}</a>", False, "li") for _ in range(n))
    page = f"<div>{block(words(1, 3), False, 'div')}<ul>{links(pick.randint(2, 6))}</ul></div><div>"
    page += "<div>" + block(words(3, 8), True, "h1")
    for _ in range(pick.randint(3, 9)):
        kind = pick.random()
        page += block(words(25, 80) + ".", True) if kind < 0.6 else block(words(1, 4), True) if kind < 0.85 else f"<div><div>{block(words(2, 6), False, 'b')}</div></div>"
    page += block(words(25, 60) + ".", True) + "</div><div><ul>" + links(pick.randint(2, 5)) + "</ul>" + block(words(3, 9) + " 12", False) + "</div></div>"
    return page + f"<div>{block('All rights reserved 2024', False, 'div')}{block(words(1, 4) + ' 5', False, 'span')}</div>", [(re.sub("<[^>]*>", "", t), k) for t, k in out]


def test_the_cut_decides_where_names_are_silent():
    pick = random.Random(5)
    right_signs = right_cut = changed = total = 0
    for _ in range(200):
        page, truth = soup(pick)
        found = ht.blocks(page)
        assert [b.text for b in found] == [t for t, _ in truth]
        scores = [ht.score(b) for b in found]
        cut = ht.minimum_cut([max(x, 0) for x in scores], [max(-x, 0) for x in scores], ht.ties(found))
        signs = [x > 0 for x in scores]
        changed += sum(a != b for a, b in zip(cut, signs, strict=True))
        right_signs += sum(a == k for a, (_, k) in zip(signs, truth, strict=True))
        right_cut += sum(a == k for a, (_, k) in zip(cut, truth, strict=True))
        total += len(truth)
    print(f"{total} blocks: {changed} labels changed by the cut, right by sign {right_signs / total:.3f}, by cut {right_cut / total:.3f}")
    assert right_cut > right_signs + total // 50 and right_cut > 0.93 * total


def test_time_grows_with_length_only():
    began = time.perf_counter()
    deep = "<span>" * 30_000 + "word " + "</span>" * 3
    assert ht.main_text("<article><p>Here is a text.</p>" + deep) == "Here is a text. word"
    blocks = "<div>" * 8_000 + "<p>Some words stand here.</p>" * 3_000
    assert ht.main_text(blocks).count("Some") == 3_000
    ht.main_text("<p>" + "<i><b>" * 20_000 + "</p>" * 20_000)
    ht.main_text("<table><tr><td>x" * 8_000)
    ht.main_text("<div" * 300_000)
    ht.main_text('<a href="' * 100_000)
    ht.main_text("<script>" * 50_000)
    assert time.perf_counter() - began < 12


def test_unusual_containers_are_read():
    page = "<article><p>The formula <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds here.</p><object>A chart of the year, in words.</object><noscript><p>The same, for readers without scripts.</p></noscript></article>"
    assert ht.main_text(page) == "The formula x=1 holds here. A chart of the year, in words. The same, for readers without scripts."


def test_training_from_telling_containers(spark):
    page = "<nav>{0}</nav><article>{1}</article><footer>Short line of footer text.</footer>"
    rows = [(i, f"u{i}", page.format("<a href=x>menu one</a>" * 3, f"<p>{PROSE * (i % 4 + 1)}</p>")) for i in range(300)]
    weights = ht.fit(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert weights != ht.PRIOR and weights[3] < 0 < weights[1]
    assert ht.fit(spark.createDataFrame([], "page_id long, url string, html string")) == ht.train(["<p>silent</p>"]) == ht.PRIOR
    assert ht.main_text(rows[0][2], weights) == PROSE.strip()


def test_given_pages_and_rows(spark):
    import html

    path = "/root/testdata/sf0.01/pages.parquet"
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{path}'").fetchall()
    weights = ht.train([page for *_, page in rows[::3]])
    for _, _, page in rows:
        inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        assert ht.main_text(page) == ht.main_text(page, weights) == " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", inside))).split())
    frame = spark.createDataFrame([(1, None, None, "x"), (2, "u", "<p>Hello there, reader.</p>", "y"), (2, "u", "<p>Hello there, reader.</p>", "y"), (None, "", "", None)], "page_id long, url string, html string, text string")
    got = ht.extract(frame).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == [("1", "", 0), ("2", "Hello there, reader.", 20), ("2", "Hello there, reader.", 20), ("None", "", 0)]
    assert ht.extract(frame.limit(0)).count() == 0
