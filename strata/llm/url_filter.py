"""URL filters: rules first, then gradient-boosted trees over lexical features.

The path of the data is DataFrame functions only. Features of labelled URLs are computed by the same expressions as
those of the table; the trees are grown on the driver from at most MAX_LABELLED rows and become CASE expressions, so a
verdict is one projection without a shuffle.

Labelled URLs are a table (url, label; 1 is block). Without one the trees learn from invented URLs (invented()), whose
names are random syllables and whose habits are those commonly told of unwanted addresses: many hyphens, digits, random
names, long parameter lists, numeric hosts, cheap suffixes; each kind also has a share of the other's habits.

Host: what stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#`
or the end. A rule fits its host and all subdomains where the path starts with the rule's; the longest rule wins, of
equally long ones that with the longer host, then a block.

Defined cases: null urls and urls without `://` have an empty host and path, fit no rule and are judged by the trees
like others; without both kinds of label the trees say the only one there is (allow without labels); repeated rows each
get their row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
MAX_LABELLED, TREES, DEPTH, RATE, CUTS, LEAST = 5000, 40, 3, 0.3, 16, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of invented URLs and how often each is drawn for ordinary and for unwanted ones.
TOPS = {"com": (40, 30), "org": (15, 4), "net": (10, 10), "edu": (6, 0), "de": (6, 3), "fr": (5, 2), "info": (3, 9), "xyz": (1, 11), "top": (1, 11), "click": (0, 6), "biz": (1, 6)}
ENDINGS = {"": (60, 55), "html": (20, 10), "php": (6, 20), "pdf": (5, 1), "exe": (0, 4)}


def invented(n: int = 3000, seed: int = 1) -> list[tuple[str, int]]:
    """n labelled URLs, a third of them unwanted. Other seeds give other names."""
    pick = random.Random(seed)
    syllable = lambda: pick.choice("bcdfghjklmnprstvwz") + pick.choice("aeiou") + pick.choice(["", "", "n", "r", "s", "l"])
    word = lambda most=3: "".join(syllable() for _ in range(pick.randint(1, most)))
    noise = lambda low, high: "".join(pick.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=pick.randint(low, high)))
    drawn = lambda table, k: pick.choices(list(table), [w[k] for w in table.values()])[0]
    out = []
    for i in range(n):
        bad = int(i % 3 == 0)
        habit = pick.choices(("plain", "hyphens", "noise", "digits", "number"), ((72, 20, 2, 5, 1), (12, 48, 18, 16, 6))[bad])[0]
        if habit == "number":
            host = ".".join(str(pick.randint(1, 254)) for _ in range(4))
        else:
            name = {
                "plain": lambda: "".join(word() for _ in range(pick.randint(1, 2))),
                "hyphens": lambda: "-".join(word() for _ in range(pick.randint(2, 3 + bad))),
                "noise": lambda: noise(8, 18),
                "digits": lambda: word() + str(pick.randint(1, 9999)),
            }[habit]()
            before = pick.choices(["", "www.", word(2) + ".", noise(4, 9) + "."], ((40, 40, 18, 2), (45, 20, 20, 15))[bad])[0]
            host = f"{before}{name}.{drawn(TOPS, bad)}"
        steps = [word() if pick.random() < (0.8, 0.55)[bad] else noise(3, 12) for _ in range(pick.randint(0, 4))]
        ending = drawn(ENDINGS, bad)
        path = "".join("/" + x for x in steps) + (f".{ending}" if steps and ending else "/" * pick.randint(0, 1))
        many = pick.choices((0, 1, 2, 4, 7), ((75, 15, 7, 2, 1), (40, 15, 20, 15, 10))[bad])[0]
        query = "&".join(f"{word(1)}={noise(1, (6, 14)[bad])}" for _ in range(many))
        secure = "s" * (pick.random() < (0.85, 0.5)[bad])
        out.append((f"http{secure}://{host}{path}{'?' * bool(query)}{query}", bad))
    return out


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and what it says, both null where none fits."""
    split = [(action, rule, *rule.partition("/")[::2]) for action, rule in rules]
    split.sort(key=lambda r: (-len(r[1]), -len(r[2]), r[0] != BLOCK, r[1]))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text, of, start in reversed(split):
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit("/" + start))
        rule, said = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(said)
    return rule, said


def entropy(text: Column) -> Column:
    """Bits a character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url.cast("string"), F.lit(""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    count = lambda where, pattern: F.regexp_count(where, F.lit(pattern)).cast("double")
    share = lambda where, pattern: count(where, pattern) / F.greatest(F.length(where), F.lit(1))
    return {
        "length": F.length(text).cast("double"),
        "host_length": F.length(host).cast("double"),
        "depth": count(path, "/+[^/]"),
        "labels": count(host, "[^.]+"),
        "digit_ratio": share(text, "[0-9]"),
        "host_digits": count(host, "[0-9]"),
        "hyphens": count(host, "-"),
        "vowel_ratio": share(host, "[aeiou]"),
        "entropy": F.round(entropy(host), 6),
        "parameters": count(query, "[^&]+"),
        "secure": F.startswith(text, F.lit("https:")).cast("double"),
    }


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    """What stands last: the host's top label, and the ending of a file name."""
    last = F.substring_index(path, "/", -1)
    return {"top": F.substring_index(host, ".", -1), "ending": F.when(F.contains(last, F.lit(".")), F.substring_index(last, ".", -1)).otherwise("")}


SUFFIXES = ("top", "ending")


def described(url: str) -> dict:
    """The features and suffixes of one URL in plain Python, for tests and for the SQL that says the same."""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c in UPPER else c for c in host)
    query = re.search(r"\?([^#]*)", url)
    count = lambda where, pattern: float(len(re.findall(pattern, where)))
    shares = [c / len(host) for c in Counter(host).values()]
    last = path.rsplit("/", 1)[-1]
    return {
        "length": float(len(url)),
        "host_length": float(len(host)),
        "depth": count(path, "/+[^/]"),
        "labels": count(host, "[^.]+"),
        "digit_ratio": count(url, "[0-9]") / max(1, len(url)),
        "host_digits": count(host, "[0-9]"),
        "hyphens": count(host, "-"),
        "vowel_ratio": count(host, "[aeiou]") / max(1, len(host)),
        "entropy": round(-sum(x * math.log2(x) for x in shares), 6) + 0.0,
        "parameters": count(query[1] if query else "", "[^&]+"),
        "secure": float(url.startswith("https:")),
        "top": host.rsplit(".", 1)[-1],
        "ending": last.rsplit(".", 1)[-1] if "." in last else "",
        "url": url,
    }


class Trees:
    """Boosted regression trees for logistic loss, and the log odds of blocking by suffix."""

    def __init__(self, rows: list[dict], labels: list[int]):
        self.base, self.trees, self.odds = 0.0, [], {}
        order = sorted(range(len(rows)), key=lambda i: (rows[i]["url"], labels[i]))
        rows, y = [rows[i] for i in order], np.array([labels[i] for i in order], float)
        if not rows or y.min() == y.max():
            self.base = 4.0 if rows and y[0] else -4.0
            return
        names = sorted(k for k, v in rows[0].items() if isinstance(v, float))
        values = {n: np.array([r[n] for r in rows]) for n in names}
        for name in SUFFIXES:
            tally: dict[str, list[int]] = {}
            for row, label in zip(rows, y, strict=True):
                tally.setdefault(row[name], [0, 0])[int(label)] += 1
            # Rare suffixes say nothing: with few rows their odds would be their own labels.
            self.odds[name] = {k: round(math.log((b + 1) / (a + 1)), 6) for k, (a, b) in sorted(tally.items()) if a + b >= LEAST}
            values[f"{name}_odds"] = np.array([self.odds[name].get(r[name], 0.0) for r in rows])
        bins = {}
        for name, column in sorted(values.items()):
            different = np.unique(column)
            bounds = different[1:] if len(different) <= CUTS else np.unique(different[[len(different) * i // CUTS for i in range(1, CUTS)]])
            bins[name] = (bounds.tolist(), np.searchsorted(bounds, column, "right"))
        self.base = math.log(y.mean() / (1 - y.mean()))
        margin = np.full(len(rows), self.base)
        for _ in range(TREES):
            chance = 1 / (1 + np.exp(-margin))
            self.trees.append(self._grow(y - chance, chance * (1 - chance), np.arange(len(rows)), bins, DEPTH, margin))

    def _grow(self, slope, curve, at, bins, depth, margin):
        """A tree over the rows `at`; margins take its values."""
        g, h = slope[at].sum(), curve[at].sum()
        best = (1e-6, None, 0)
        for name, (bounds, bin_) in bins.items() if depth else ():
            here = bin_[at]
            a, b, n = (np.bincount(here, w, len(bounds) + 1)[:-1].cumsum() for w in (slope[at], curve[at], None))
            gain = np.where(np.minimum(n, len(at) - n) >= LEAST, a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1), 0.0)
            if len(gain) and gain.max() > best[0] + 1e-9:
                best = (gain.max(), name, int(gain.argmax()))
        if best[1] is None:
            leaf = round(float(RATE * g / (h + 1)), 9)
            margin[at] += leaf
            return leaf
        bounds, bin_ = bins[best[1]]
        low = bin_[at] <= best[2]
        return (best[1], bounds[best[2]], self._grow(slope, curve, at[low], bins, depth - 1, margin), self._grow(slope, curve, at[~low], bins, depth - 1, margin))

    def _value(self, tree, row) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
        return tree

    def margin(self, row: dict) -> float:
        return self.base + sum(self._value(t, row) for t in self.trees)

    def _written(self, leaf: Callable, fork: Callable, plus: Callable):
        of = lambda tree: fork(*tree[:2], of(tree[2]), of(tree[3])) if isinstance(tree, tuple) else leaf(tree)
        out = leaf(self.base)
        for tree in self.trees:
            out = plus(out, of(tree))
        return out

    def column(self) -> Column:
        """The log odds of blocking, over columns of the features."""
        return self._written(lambda x: F.lit(float(x)), lambda name, cut, a, b: F.when(F.col(name) < cut, a).otherwise(b), lambda a, b: a + b)

    def sql(self) -> str:
        """The same in SQL."""
        return self._written(lambda x: f"{x:.17e}", lambda name, cut, a, b: f"CASE WHEN {name} < {cut:.17e} THEN {a} ELSE {b} END", lambda a, b: f"{a}\n+ {b}")

    def odds_columns(self) -> dict[str, Column]:
        """Suffix statistics by lookup in a constant map of at most MAX_LABELLED keys."""
        out = {}
        for name in SUFFIXES:
            known = self.odds.get(name)
            table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair)) if known else None
            out[f"{name}_odds"] = F.coalesce(F.try_element_at(table, F.col(name)), F.lit(0.0)) if known else F.lit(0.0)
        return out


def featured(urls: DataFrame, url: str) -> DataFrame:
    """Add host, path, features and suffixes."""
    host, path = parts(F.col(url))
    urls = urls.withColumns({"host": host, "path": path})
    return urls.withColumns(lexical(F.col(url), F.col("host"), F.col("path")) | suffixes(F.col("host"), F.col("path")))


def fit(spark: SparkSession, labelled: DataFrame | None = None) -> Trees:
    """labelled: url, label (1: block); at most MAX_LABELLED rows are read, by a hash of the url."""
    if labelled is None:
        labelled = spark.createDataFrame(invented(), "url string, label int")
    chosen = labelled.select("url", F.col("label").cast("int")).where("label in (0, 1)").orderBy(F.xxhash64("url"), "url", "label").limit(MAX_LABELLED)
    rows = [r.asDict() | {"url": r["url"] or ""} for r in featured(chosen, "url").collect()]
    return Trees(rows, [r["label"] for r in rows])


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]], trees: Trees) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, score (the trees' probability of blocking)."""
    rows = featured(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")), "url")
    rows = rows.withColumns(trees.odds_columns())
    rule, said = ruled(F.col("host"), F.col("path"), rules)
    margin = trees.column()
    verdict = F.coalesce(said, F.when(margin > 0, BLOCK).otherwise(ALLOW))
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), (1 / (1 + F.exp(-margin))).alias("score"))
