"""One query per operator, over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialbook.llm import (
    bpe,
    collocations,
    decontamination,
    fingerprints,
    licenses,
    line_dedup,
    merkle,
    pii,
    quality,
    secret_scan,
    simhash,
    token_counts,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_bpe_round_trip")
def _bpe(spark, folder):
    return bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_fingerprints")
def _fingerprints(spark, folder):
    return fingerprints.edited_fingerprints(table(spark, folder, "documents"))


WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex FROM p),
b AS (
  SELECT page_id, n, string_agg(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (k // 4), 5))::BIGINT >> (5 * (3 - k % 4))) & 31)::INTEGER, 1),
    '' ORDER BY k) AS digest
  FROM h, range(32) AS r(k) GROUP BY page_id, n, hex),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM b)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""


@query("op3_warc_transactions", WARC_SQL)
def _warc(spark, folder):
    return warc.archived(table(spark, folder, "pages"))


@query("op4_quality_rules")
def _quality(spark, folder):
    docs = table(spark, folder, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, folder, "labels")))


@query("op5_token_counts")
def _token_counts(spark, folder):
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


WORD_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({WORD_SQL}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({WORD_SQL}, []) AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, i, size, array_to_string(w[i + 1 : i + size], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, win)),
n AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS spot FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
m AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


@query("op6_decontamination", DECONTAMINATION_SQL)
def _decontamination(spark, folder):
    found = decontamination.search_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("hit_spans")


@query("op7_personal_data")
def _personal_data(spark, folder):
    return pii.find_personal_data(table(spark, folder, "documents"))


def _secrets_sql() -> str:
    """Matches of each rule with the text between them; lengths give the places."""
    rules = secret_scan.BASE + secret_scan.MORE

    def matches(order: int, rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        if rule.kind == "hex":  # runs are maximal, so the least length can stand in the pattern
            pattern = f"{pattern[:-1]}{{{rule.least},}}"
        return f"""SELECT doc_id, '{rule.kind}' AS kind, {order} AS ord, {rule.least} AS least, regexp_extract_all(t, '{pattern}') AS m,
  regexp_extract_all(t, '{pattern}', {rule.group}) AS v, string_split_regex(t, '{pattern}') AS g FROM d"""

    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in rules)
    base = ", ".join(f"'{r.kind}'" for r in secret_scan.BASE)
    listed = "string_agg(kind || ':' || start_ || ':' || (start_ + n), ',' ORDER BY start_, ord)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS ({' UNION ALL '.join(matches(k, r) for k, r in enumerate(rules))}),
u AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM r WHERE len(m) > 0),
p AS (
  SELECT doc_id, kind, ord, length(m[i]) AS n, CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start_
  FROM u WHERE length(v[i]) >= least),
s AS (SELECT d.doc_id, {counts}, coalesce({listed} FILTER (kind IN ({base})), '') AS b, coalesce({listed}, '') AS spans
  FROM d LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT * EXCLUDE (b), sha256(b) AS base_sha256 FROM s"""


@query("op8_secret_scan", _secrets_sql())
def _secret_scan(spark, folder):
    return secret_scan.find_secrets(table(spark, folder, "documents"))


@query("op9_simhash_groups")
def _simhash(spark, folder):
    return simhash.near_groups(table(spark, folder, "documents"))


LINES_SQL = f"""
WITH d AS (SELECT doc_id, source, text FROM documents),
pages AS (SELECT DISTINCT source, text FROM d WHERE text IS NOT NULL),
totals AS (SELECT source, count(*) AS host_pages FROM pages GROUP BY source),
counts AS (
  SELECT source, line, count(*) AS n
  FROM (SELECT source, text, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM pages)
  WHERE trim(line) <> '' GROUP BY source, line),
bad AS (
  SELECT source, list(line) AS drops FROM counts JOIN totals USING (source)
  WHERE n >= {line_dedup.MIN_PAGES} AND n::DOUBLE / host_pages > {line_dedup.RATIO}::DOUBLE GROUP BY source),
k AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS every,
         list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(drops, []), x)) AS stay
  FROM d LEFT JOIN bad USING (source))
SELECT doc_id, coalesce(len(every), 0)::BIGINT AS n_lines, coalesce(len(every) - len(stay), 0)::BIGINT AS n_dropped,
       sha256(coalesce(array_to_string(stay, chr(10)), '')) AS text_sha256
FROM k
"""


@query("op10_line_dedup", LINES_SQL)
def _line_dedup(spark, folder):
    found = line_dedup.drop_boilerplate(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def _hashed_field(name: str) -> str:
    return f"coalesce(octet_length(encode({name}::VARCHAR))::VARCHAR || ':' || {name}::VARCHAR, '-')"


_HEAD = " || ".join(map(_hashed_field, ("doc_id", "source", "lang")))
_TAIL = _hashed_field("text")

MANIFEST_SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER () AS row, xor(list_reduce(
      list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc
  FROM documents),
l AS (
  SELECT row, doc_id, lang, crc % 7 = 0 AS tampered, head, tail, coalesce(octet_length(encode(n_chars::VARCHAR))::VARCHAR || ':' || n_chars::VARCHAR, '-') AS own,
         coalesce(octet_length(encode((n_chars + 1)::VARCHAR))::VARCHAR || ':' || (n_chars + 1)::VARCHAR, '-') AS other
  FROM (SELECT *, {_HEAD} AS head, {_TAIL} AS tail FROM d)),
leaves AS (
  SELECT row, doc_id, lang, sha256(head || own || tail) AS leaf, CASE WHEN tampered THEN sha256(head || other || tail) ELSE sha256(head || own || tail) END AS claimed FROM l),
trees AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY doc_id NULLS FIRST, leaf) AS nodes FROM leaves GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM trees WHERE len(nodes) > 1),
subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS spot FROM trees WHERE len(nodes) = 1),
top AS (
  SELECT 0 AS level, list(subroot ORDER BY spot) AS nodes FROM subroots HAVING count(*) > 0
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM top WHERE len(nodes) > 1),
placed AS (
  SELECT leaves.*, subroot, subroots.spot AS group_spot, row_number() OVER (PARTITION BY leaves.lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot
  FROM leaves JOIN subroots ON leaves.lang IS NOT DISTINCT FROM subroots.lang),
runs AS (
  SELECT row, 0 AS part, level, placed.spot >> level AS i, nodes FROM placed JOIN trees ON placed.lang IS NOT DISTINCT FROM trees.lang AND len(nodes) > 1
  UNION ALL
  SELECT row, 1, level, group_spot >> level, nodes FROM placed JOIN top ON len(nodes) > 1),
steps AS (
  SELECT row, row_number() OVER (PARTITION BY row ORDER BY part, level) AS step, i % 2 = 0 AS is_left, coalesce(nodes[xor(i, 1) + 1], '') AS other FROM runs),
folded AS (
  SELECT row, 0 AS step, claimed AS node FROM placed
  UNION ALL
  SELECT folded.row, steps.step, sha256(CASE WHEN is_left THEN node || other ELSE other || node END) FROM folded JOIN steps ON steps.row = folded.row AND steps.step = folded.step + 1),
ends AS (SELECT row, max_by(node, step) AS folded_root FROM folded GROUP BY row),
proofs AS (SELECT row, string_agg(other, '' ORDER BY step) AS proof FROM steps GROUP BY row)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN ends USING (row) LEFT JOIN proofs USING (row), (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1)
"""


@query("op11_merkle_manifest", MANIFEST_SQL)
def _manifest(spark, folder):
    return merkle.tampered_proofs(table(spark, folder, "documents"))


def _licenses_sql() -> str:
    """Templates as tables; starts of the looked-up words are grouped, and complete groups kept."""
    templates = licenses.BASE + licenses.MORE
    words, phrases = [], []
    for t, template in enumerate(templates):
        own = licenses.split(template.text)
        words += [f"({t}, {p}, '{w}')" for p, w in enumerate(own)]
        for phrase in template.phrases:
            n = len(licenses.split(phrase))
            at = next(i for i in range(len(own)) if " ".join(own[i : i + n]) == phrase)
            phrases.append(f"({t}, {at}, {n}, '{phrase}')")
    labels = ", ".join(f"({t}, '{x.label}', {x.base})" for t, x in enumerate(templates))
    return f"""
WITH tw(t, p, w) AS (VALUES {", ".join(words)}),
tp(t, p, n, phrase) AS (VALUES {", ".join(phrases)}),
tl(t, label, base) AS (VALUES {labels}),
d AS (SELECT doc_id, row_number() OVER () AS row, coalesce({WORD_SQL}, []) AS w FROM documents),
s AS (SELECT row, unnest(w) AS w, unnest(range(len(w))) AS i FROM d),
v AS (SELECT s.row, s.w, s.i FROM s JOIN (SELECT DISTINCT w FROM tw) USING (w)),
df AS (SELECT w, count(DISTINCT row) AS n FROM v GROUP BY w),
idf AS (
  SELECT t, p, tw.w, coalesce(n, 0) AS n, CAST(round(1000000 * ln(1 + (SELECT count(*) FROM d) / greatest(coalesce(n, 0), 1)::DOUBLE)) AS BIGINT) AS weight
  FROM tw LEFT JOIN df USING (w)),
rare AS (
  SELECT t, w, p, k, least(2, count(*) OVER (PARTITION BY t)) AS least_n
  FROM (SELECT t, w, min(p) AS p, row_number() OVER (PARTITION BY t ORDER BY min(n), -length(w), min(p)) AS k FROM idf GROUP BY t, w)
  WHERE k <= {licenses.INDEXED}),
have AS (
  SELECT row, t, w, p, least_n, row_number() OVER (PARTITION BY row, t ORDER BY k) AS place
  FROM rare JOIN (SELECT DISTINCT row, w FROM v) USING (w)),
looked AS (SELECT *, count(*) OVER (PARTITION BY row, t) AS n FROM have WHERE place <= {licenses.LOOKED}),
starts AS (
  SELECT v.row, t, i - p AS start_ FROM looked JOIN v ON v.row = looked.row AND v.w = looked.w
  WHERE n >= least_n GROUP BY v.row, t, i - p, n HAVING count(*) = n),
verified AS (
  SELECT row, t, start_, bool_and(start_ + p >= 0 AND array_to_string(d.w[start_ + p + 1 : start_ + p + n], ' ') = phrase) AS ok
  FROM starts JOIN tp USING (t) JOIN d USING (row) GROUP BY row, t, start_),
shares AS (
  SELECT row, t, start_, sum(CASE WHEN start_ + p >= 0 AND d.w[start_ + p + 1] = idf.w THEN weight ELSE 0 END)::DOUBLE / sum(weight)::DOUBLE AS share
  FROM starts JOIN idf USING (t) JOIN d USING (row) GROUP BY row, t, start_),
f AS (
  SELECT row, count(*) FILTER (ok AND base) AS n_base, min(start_) FILTER (ok AND base) AS first_word, max(start_) FILTER (ok AND base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (ok AND base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (ok) AS labels,
         max(CASE WHEN ok THEN share ELSE share / 2 END) AS score
  FROM verified JOIN shares USING (row, t, start_) JOIN tl USING (t) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN f USING (row)
"""


@query("op12_license_scan", _licenses_sql())
def _license_scan(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


COLLOCATIONS_SQL = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, size, w, unnest(range(len(w) - size + 1)) AS i FROM w, range(1, 4) AS s(size) WHERE len(w) >= size),
f AS (SELECT lang, size, w[i + 1 : i + size] AS words, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, words, f AS a FROM f WHERE size > 1 AND f >= {collocations.THRESHOLD}),
cuts AS (
  SELECT c.lang, c.words, a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c) AS c
  JOIN f AS l ON l.lang = c.lang AND l.words = c.words[1:k] JOIN f AS r ON r.lang = c.lang AND r.words = c.words[k + 1 :]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
over AS (
  SELECT lang, words, max(a) AS longer
  FROM (SELECT lang, words[1:2] AS words, a FROM c WHERE size = 3 UNION ALL SELECT lang, words[2:3], a FROM c WHERE size = 3) GROUP BY lang, words),
k AS (
  SELECT b.lang, array_to_string(b.words, ' ') AS phrase, a, l, r, score
  FROM best AS b LEFT JOIN over AS o ON o.lang = b.lang AND o.words = b.words WHERE longer IS NULL OR 100 * longer < {collocations.CONTAINED} * a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM k JOIN n USING (lang) QUALIFY rank <= {collocations.FIRST}
"""


@query("op13_collocations", COLLOCATIONS_SQL)
def _collocations(spark, folder):
    return collocations.collocations(table(spark, folder, "documents"))
