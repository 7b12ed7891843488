"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

import math

from .common import LOWER, UPPER
from .mixing import MixConfig
from .quality import QualityConfig
from .urls import UrlConfig

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def urls(config: UrlConfig = UrlConfig()) -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in config.rules)
    hosts = ", ".join(f"('{h}')" for h in config.hosts)
    return f"""WITH rules(h, p, v) AS (VALUES {rules}), hosts(h) AS (VALUES {hosts}),
r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
k AS (SELECT u.*, (SELECT max_by({{'k': h || p, 'v': v}}, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS b,
  (SELECT max_by(h, length(h)) FROM hosts WHERE host = h OR ends_with(host, '.' || h)) AS own FROM u)
SELECT page_id, host, path, b.k AS rule, coalesce(b.v, CASE WHEN own IS NOT NULL THEN 'block' END, 'allow') AS verdict, CASE WHEN b IS NULL THEN own END AS listed_key FROM k"""


def mixing(config: MixConfig = MixConfig()) -> str:
    weights = ", ".join(str(float(w)) + "::DOUBLE" for w in config.weights)
    return rf"""WITH w AS (SELECT doc_id, source, text, {_WORDS} AS w FROM documents),
d AS (SELECT doc_id, source, len(w) AS size, length(array_to_string(w, '')) AS chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS symbols FROM w),
k AS (SELECT *, -ln((('0x' || substr(md5('{config.seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / greatest(0.1::DOUBLE, 1.0::DOUBLE - 5.0::DOUBLE * symbols / greatest(chars, 1)) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
c AS (SELECT *, source_size * {config.most} AS cap, [{weights}][(rank - 1) % {len(config.weights)} + 1] AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM c WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min_by(level, (cap / weight, rank)) AS level FROM l WHERE level <= cap / weight),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(f.level, 0) * weight) AS target FROM l, f),
q AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs, round(target)::BIGINT AS quota FROM t),
o AS (SELECT doc_id, size, source_size, target, epochs, quota - epochs * source_size AS rest, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k JOIN q ON k.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM o"""


def quality(config: QualityConfig = QualityConfig()) -> str:
    """Sketches as lists of bins: the bin at a rank is that of the value at it."""
    names = [n for n, _ in config.floors]
    share = "least(1.0::DOUBLE, {}::DOUBLE / greatest({}, 1)::DOUBLE) AS {}"
    signals = ", ".join(share.format(a, b, n) for n, (a, b) in zip(names, (("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_capitals", "word_chars")), strict=True))
    bins = ", ".join(f"CASE WHEN {n} <= 0 THEN -1073741824 ELSE ceil(ln({n}) / {math.log(config.base())!r}::DOUBLE - 1e-9::DOUBLE)::INT END AS {n}_bin" for n in names)
    bin_at = lambda n, p: f"list_sort(list({n}_bin))[ceil(count(*) * {p}::DOUBLE)::BIGINT]"
    at = lambda n, p: f"(CASE WHEN {bin_at(n, p)} = -1073741824 THEN 0.0::DOUBLE ELSE {2 / (config.base() + 1)!r}::DOUBLE * pow({config.base()!r}::DOUBLE, {bin_at(n, p)}) END)"
    fence = ", ".join(f"{at(n, config.high)} + {config.spread}::DOUBLE * greatest({at(n, config.high)} - {at(n, config.low)}, {v}::DOUBLE) AS {n}" for n, v in config.floors)
    pick = lambda n: f"CASE WHEN own.docs >= {config.min_docs} THEN own.{n} WHEN lang_.docs >= {config.min_docs} THEN lang_.{n} ELSE every.{n} END"
    over = " OR ".join(f"s.{n} > {pick(n)}" for n in names)
    return rf"""WITH w AS (SELECT doc_id, lang, source, text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, concat(w[i], chr(1), w[i + 1], chr(1), w[i + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
v AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
c AS (SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(v.n, 0) AS n_repeat_words, length(regexp_replace(coalesce(text, ''), '[^A-Z!]+', '', 'g')) AS n_capitals FROM w LEFT JOIN v USING (doc_id)),
r AS (SELECT *, {signals} FROM c), s AS (SELECT *, {bins} FROM r),
own AS (SELECT lang, source, count(*) AS docs, {fence} FROM s GROUP BY lang, source), lang_ AS (SELECT lang, count(*) AS docs, {fence} FROM s GROUP BY lang), every AS (SELECT count(*) AS docs, {fence} FROM s),
j AS (SELECT s.*, n_words < {config.min_words} OR n_repeat_words * 100 > n_words * {config.max_repeat_percent} AS base_failed, {over} AS over FROM s JOIN own ON s.lang IS NOT DISTINCT FROM own.lang AND s.source IS NOT DISTINCT FROM own.source JOIN lang_ ON s.lang IS NOT DISTINCT FROM lang_.lang, every)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT over AS kept FROM j"""


def near_duplicates() -> str:
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : least(i + 4, len(w))], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS d, doc_id AS m FROM w UNION SELECT CASE WHEN e.a = r.d THEN e.b ELSE e.a END, r.m FROM r JOIN e ON r.d = e.a OR r.d = e.b),
c AS (SELECT d, min(m) AS component_id FROM r GROUP BY d)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.d = doc_id"""
