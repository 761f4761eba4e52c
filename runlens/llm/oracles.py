"""DuckDB texts that give the same rows, where SQL can express them."""

from runlens.llm import licenses

URL_FILTER = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r,
         coalesce(instr(url, '://') > 0, false) AS ok
  FROM pages),
split AS (
  SELECT page_id, ok,
         translate(regexp_extract(r, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^([^/?#]*)([^?#]*)', 2) AS path,
         regexp_extract(r, '^[^?#]*[?]([^#]*)', 1) AS query
  FROM rest),
keyed AS (
  SELECT page_id, host, path,
         CASE WHEN ok THEN regexp_replace(host, '^www[.]|:(80|443)$', '', 'g') || regexp_replace(path, '/+$', '') || '?' ||
           array_to_string(list_sort(list_filter(string_split(query, '&'),
             lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&') END AS key
  FROM split),
listed AS (
  SELECT DISTINCT key FROM keyed
  WHERE regexp_matches(host, 'adult|casino|cheap-pills|free-bets|spam-farm|ads-track') AND key IS NOT NULL),
rules(rule, own, start, verdict) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
  ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
best AS (
  SELECT k.page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM keyed k JOIN rules ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start)
  GROUP BY k.page_id)
SELECT k.page_id, host, path, b.rule,
       coalesce(b.verdict, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       l.key IS NOT NULL AS listed
FROM keyed k LEFT JOIN best b ON b.page_id = k.page_id LEFT JOIN listed l ON l.key = k.key
"""

QUALITY_LEDGER = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text,
         list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM docs),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM w, unnest(range(1, len(words) - 1)) AS t(i)),
again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM again, (VALUES (0), (1), (2)) AS s(o) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines,
         length(text) - length(regexp_replace(text, '\p{L}+', '', 'g')) AS n_letters,
         length(text) - length(regexp_replace(text, '\p{Lu}+', '', 'g')) AS n_upper
  FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
           + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
           + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END
           + CASE WHEN 100 * n_upper > 30 * n_letters THEN 8 ELSE 0 END
           + CASE WHEN 100 * n_letters < 60 * word_chars THEN 16 ELSE 0 END
           + CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 32 ELSE 0 END
           + CASE WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN 64 ELSE 0 END)::BIGINT AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, 'standard-1' AS version
FROM f
"""



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_scan() -> str:
    """The rules are folded over what is left of the identifiers. Boundaries are doubled, as the
    expressions of this engine cannot look around and each sentence takes its own two."""
    known = ", ".join(f"({_quoted(form)}, {_quoted(i)})" for form, i in licenses.KNOWN.items())
    rules = ", ".join(
        f"{{'rest': {_quoted(licenses.sequence_text(seq))}, 'found': [{_quoted(name)}]}}" for name, seq in licenses.ALL_RULES
    )
    sentence = f"L ({licenses.pattern(licenses.KNOWN, '(?: L)* ')}) L"
    return rf"""
WITH known(form, id) AS (VALUES {known}),
marked AS (
  SELECT doc_id, replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10), 'L') AS t
  FROM documents),
words AS (
  SELECT doc_id, regexp_replace('L ' || replace(regexp_replace(t, '([.;:!?])[\x20\x09-\x0D]+', '\1L', 'g'), 'L', ' L L ') || ' L',
    '[^a-z0-9L]+', ' ', 'g') AS w
  FROM marked),
found AS (SELECT doc_id, regexp_extract_all(w, {_quoted(sentence)}, 1) AS f FROM words),
ids AS (
  SELECT doc_id, i, id
  FROM (SELECT doc_id, i, replace(f[i], ' L', '') AS form FROM found, unnest(range(1, len(f) + 1)) AS t(i))
  JOIN known USING (form)),
sequences AS (
  SELECT d.doc_id, count(i) AS n, coalesce(string_agg(id, ',' ORDER BY i), '') AS ids,
    coalesce(string_agg('<' || id || '>', '' ORDER BY i), '') AS rest
  FROM documents d LEFT JOIN ids ON ids.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT doc_id, n AS n_sentences, ids AS sentences, array_to_string(list_reduce([{rules}],
  lambda s, r: {{'rest': replace(s.rest, r.rest, '|'), 'found': CASE WHEN contains(s.rest, r.rest)
    AND NOT list_contains(s.found, r.found[1]) THEN list_append(s.found, r.found[1]) ELSE s.found END}},
  {{'rest': rest, 'found': []::VARCHAR[]}}).found, ',') AS licences
FROM sequences
"""


WARC = """
WITH p AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, url, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM f
"""



REPEATED_PASSAGES = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
windows AS (
  SELECT r, i, array_to_string(w[i : i + 34], ' ') AS t FROM d, unnest(range(1, len(w) - 33)) AS s(i)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY t) > 1),
words AS (
  SELECT d.r, d.doc_id, p, d.w[p] AS word,
         count(a.i) OVER (PARTITION BY d.r ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS covered
  FROM d, unnest(range(1, len(w) + 1)) AS s(p) LEFT JOIN again a ON a.r = d.r AND a.i = p),
kept AS (
  SELECT r, count(*) FILTER (covered) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT covered) AS text
  FROM words GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

RANKED_SEARCH = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
lengths AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM d GROUP BY r),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
tf AS (SELECT r, term, count(*) AS tf FROM d GROUP BY r, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, totals GROUP BY term),
items AS (
  SELECT DISTINCT k, item_id, term FROM (
    SELECT row_number() OVER () AS k, item_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) AS i),
scores AS (
  SELECT k, item_id, r, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM items JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (r), totals
  GROUP BY k, item_id, r, doc_id),
ranked AS (
  SELECT k, item_id, doc_id, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id)::INTEGER AS rank
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def vector_codes(rounds: int = 4, entries: int = 256) -> str:
    """One pair of steps per round; a distance and its entry are one number, so the least of
    them is the nearest entry and the first one on ties."""

    def nearest(k: int) -> str:
        return rf"""
a{k} AS MATERIALIZED (
  SELECT vec_id, p, any_value(u) AS u, min(CAST(list_dot_product(u, u) - 2 * list_dot_product(u, c)
         + list_dot_product(c, c) AS BIGINT) * {entries} + e) AS best
  FROM parts JOIN b{k} USING (p) GROUP BY vec_id, p)"""

    def moved(k: int) -> str:
        return rf"""
s{k} AS (
  SELECT p, best % {entries} AS e, i, CAST(floor(sum(u[i]) / count(*)) AS DOUBLE) AS mean
  FROM a{k}, range(1, 1 + CAST(len(u) AS BIGINT)) AS t(i) GROUP BY p, best % {entries}, i),
b{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.c, b{k}.c) AS c
  FROM b{k} LEFT JOIN (SELECT p, e, list(mean ORDER BY i) AS c FROM s{k} GROUP BY p, e) m USING (p, e))"""

    steps = [x for k in range(rounds) for x in (nearest(k), moved(k))]
    return rf"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS u FROM kept, range(4) AS t(p)),
b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, u AS c
  FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})),
{",".join([*steps, nearest(rounds)])},
coded AS (
  SELECT vec_id, string_agg(format('{{:02x}}', best % {entries}), '' ORDER BY p) AS code,
         CAST(sum(best // {entries}) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id),
digest AS (
  SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM b{rounds}, range(1, 1 + CAST(len(c) AS BIGINT)) AS t(i))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest
"""


# The checksum's table follows from its polynomial: eight halvings of each byte.
SHARDS = """
WITH RECURSIVE halved(k, r, c) AS (
  SELECT k, 0, k FROM range(256) AS t(k)
  UNION ALL
  SELECT k, r + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM halved WHERE r < 8),
codes AS (SELECT list(c ORDER BY k) AS codes FROM halved WHERE r = 8),
bytes AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS digits
  FROM documents),
summed AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(
    list_transform(range(1, len(digits), 2), lambda i: CAST('0x' || substr(digits, i, 2) AS BIGINT)),
    lambda crc, byte: xor(crc >> 8, codes[xor(crc, byte) % 256 + 1]),
    4294967295)) AS text_crc32
  FROM bytes, codes),
placed AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run,
    CAST(sum(size) OVER () AS BIGINT) AS all_bytes
  FROM summed),
sharded AS (
  SELECT *, CAST(least(15, (2 * run - size) * 16 // (2 * all_bytes)) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY run) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM sharded
"""


ORACLES = {
    "op1_url_filter": URL_FILTER,
    "op3_warc": WARC,
    "op4_licenses": license_scan(),
    "op5_quality": QUALITY_LEDGER,
    "op8_shards": SHARDS,
    "op11_repeated_passages": REPEATED_PASSAGES,
    "op12_ranked_search": RANKED_SEARCH,
    "op13_vector_codes": vector_codes(),
}
