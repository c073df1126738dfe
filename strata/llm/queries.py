"""One query for each corpus operator over its whole table, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.llm import bpe, decontaminate, exact_dedup, html_text, pii, simhash, substrings, toxicity, url_filter, warc
from strata.llm.common import table


def tokenizer(name: str = "byte_bpe_50k.tiktoken", path: str | None = None, pattern: str | None = None) -> bpe.Vocabulary:
    """A rank file's place and its pattern are parameters; by default the installed public files."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path(name), pattern or public_tokenizers.PATTERN
    return bpe.Vocabulary.load(path, pattern)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(spark, table(spark, sf_dir, "documents"), tokenizer())


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit(pages))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, url_filter.fit(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_byte_bpe, op2_exact_dedup, op3_html_text, op4_toxicity, op5_pii_surrogates, op6_substring_dedup, op7_simhash, op8_warc, op9_url_filter, op10_decontamination)
}

def _url_sql() -> str:
    """The rules, the features and the fitted trees in SQL."""
    trees = url_filter.Trees([url_filter.described(u) for u, _ in url_filter.invented()], [y for _, y in url_filter.invented()])
    fits = [(action, rule, *rule.partition("/")[::2]) for action, rule in sorted(URL_RULES, key=lambda r: -len(r[1]))]
    case = lambda said: "CASE " + " ".join(f"WHEN ('.' || host) LIKE '%.{h}' AND starts_with(path, '/{p}') THEN '{said(a, r)}'" for a, r, h, p in fits) + " END"
    odds = lambda name: f"coalesce(CASE {name} " + " ".join(f"WHEN '{k}' THEN {v:.17e}" for k, v in trees.odds[name].items()) + f" END, 0e0) AS {name}_odds"
    n = lambda where, pattern: f"CAST(len(regexp_extract_all({where}, '{pattern}')) AS DOUBLE)"
    return rf"""
        WITH r AS (SELECT page_id, coalesce(url, '') AS u, CASE WHEN contains(u, '://') THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, u, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
        f AS (SELECT *, CAST(length(u) AS DOUBLE) AS length, CAST(length(host) AS DOUBLE) AS host_length, {n("path", "/+[^/]")} AS depth, {n("host", "[^.]+")} AS labels,
                     {n("u", "[0-9]")} / greatest(length(u), 1) AS digit_ratio, {n("host", "[0-9]")} AS host_digits, {n("host", "-")} AS hyphens,
                     {n("host", "[aeiou]")} / greatest(length(host), 1) AS vowel_ratio,
                     round(CASE WHEN host = '' THEN 0e0 ELSE list_aggregate(string_split(host, ''), 'entropy') END, 6) AS entropy,
                     {n("regexp_extract(u, '[?]([^#]*)', 1)", "[^&]+")} AS parameters, CASE WHEN starts_with(u, 'https:') THEN 1e0 ELSE 0e0 END AS secure,
                     string_split(host, '.')[-1] AS top, CASE WHEN contains(string_split(path, '/')[-1], '.') THEN string_split(string_split(path, '/')[-1], '.')[-1] ELSE '' END AS ending
              FROM p),
        o AS (SELECT *, {odds("top")}, {odds("ending")} FROM f)
        SELECT page_id, host, path, {case(lambda a, r: r)} AS rule,
               coalesce({case(lambda a, r: a)}, CASE WHEN {trees.sql()} > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM o"""


ORACLES: dict[str, str] = {
    "op9_url_filter": _url_sql(),
    "op2_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS points, sha256(coalesce(CAST(doc_id AS VARCHAR), '-') || chr(31) || coalesce(text, '')) AS own,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        g AS (
            SELECT *, first_value(doc_id) OVER w AS keep_id, first_value(own) OVER w AS best,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST, own))
        SELECT doc_id, keep_id, group_size, own = best AS kept, text_sha256 FROM g""",
    "op6_substring_dedup": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id,
                   list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        v AS (
            SELECT r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h
            FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        c AS (SELECT h FROM v GROUP BY h HAVING count(*) > 1),
        g AS (SELECT DISTINCT r, i + k AS pos FROM (SELECT r, i, unnest(range(0, 35)) AS k FROM v SEMI JOIN c USING (h))),
        x AS (SELECT r, list(pos) AS gone FROM g GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
               sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
                           ELSE coalesce(k.kept, '') END) AS kept_sha256
        FROM d LEFT JOIN x USING (r)
        LEFT JOIN (SELECT r, string_agg(word, ' ' ORDER BY pos) AS kept
                   FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d WHERE len(w) >= 35) ANTI JOIN g USING (r, pos)
                   GROUP BY r) k USING (r)""",
    "op8_warc": r"""
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) || '0' AS hex,
                   regexp_extract(coalesce(url, ''), '^(?:.*?://)?([^#]*)', 1) AS u
            FROM pages),
        g AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first_id FROM p),
        h AS (SELECT *, CASE WHEN page_id <> first_id THEN first_id END AS refers_to, string_split(u, '/') AS s FROM g)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
                   (((strpos('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 1 AS INT), 1)) - 1) * 16
                     + strpos('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 2 AS INT), 1)) - 1)
                    // CAST(pow(2, 3 - 5 * i % 4) AS INT)) % 32 AS INT), 1)), '') AS payload_digest,
               CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to,
               array_to_string(list_reverse(string_split(lower(s[1]), '.')), ',') || ')' || substr(u, length(s[1]) + 1) AS url_key,
               strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured
        FROM h""",
}
