"""DuckDB SQL that states the results of the queries that SQL can express.

Op 1 and the pipeline need a seeded XXH64, op 2 a Bloom filter, op 3 a tokenizer, ops 5 and 12 their models, op 10
an edit distance on characters: SQL has none of them, and the tests hold these against plain versions.
"""

from __future__ import annotations

from .mixing import BLOCK_ROWS
from .quality import LINE_LIMIT, NGRAM_LIMITS

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
     ip AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS g
            FROM i, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(s) WHERE len(w) > 0),
     dp AS (SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS g
            FROM d, (SELECT DISTINCT k FROM ip) AS ks, unnest(range(1, greatest(len(w) - k + 2, 1))) AS t(s)),
     hit AS (SELECT doc_id, s, dp.k, item_id FROM dp JOIN ip ON dp.k = ip.k AND dp.g = ip.g),
     pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + k)) AS t(p) GROUP BY doc_id),
     it AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)"""

_LIMITS = ", ".join(f"({n}, {limit}::DOUBLE)" for n, limit in sorted(NGRAM_LIMITS.items()))

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     lim(n, top) AS (VALUES {_LIMITS}),
     win AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM d, (SELECT n FROM lim UNION SELECT 8) AS ns, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(s)),
     seen AS (SELECT doc_id, n, s, count(*) OVER (PARTITION BY doc_id, n, g) AS times, row_number() OVER (PARTITION BY doc_id, n, g ORDER BY s) AS nth FROM win),
     rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM seen, unnest(range(s, s + 8)) AS t(p) WHERE n = 8 AND times > 1 GROUP BY doc_id),
     later AS (SELECT DISTINCT doc_id, n, p FROM seen, unnest(range(s, s + n)) AS t(p) WHERE nth > 1),
     chars AS (SELECT l.doc_id, l.n, sum(length(d.w[p])) AS c FROM later l JOIN d USING (doc_id) GROUP BY ALL),
     total AS (SELECT doc_id, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars FROM d),
     share AS (SELECT doc_id, max(c / greatest(word_chars, 1)) AS worst, bool_or(c / greatest(word_chars, 1) > top) AS bad FROM chars JOIN total USING (doc_id) JOIN lim USING (n) GROUP BY doc_id),
     line AS (SELECT doc_id, k, length(regexp_replace(ls[k], '[\x20\x09-\x0D]', '', 'g')) AS c, row_number() OVER (PARTITION BY doc_id, ls[k] ORDER BY k) AS nth
              FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d), unnest(range(1, len(ls) + 1)) AS t(k)),
     dup AS (SELECT doc_id, count(*) AS n, sum(c) AS c FROM line WHERE nth > 1 AND c > 0 GROUP BY doc_id),
     f AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
                  coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(dup.c, 0)::BIGINT AS dup_line_chars, coalesce(worst, 0)::DOUBLE AS worst_ngram_share, coalesce(bad, false) AS bad
           FROM d JOIN total USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN share USING (doc_id) LEFT JOIN dup USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, dup_line_chars, worst_ngram_share,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR bad OR dup_line_chars / greatest(word_chars, 1) > {LINE_LIMIT}) AS kept FROM f"""

_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * k + 1}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), q AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_DIGITS} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM q"""


def mixing(weights: dict[str, int], default: int = 1) -> str:
    """Release times and deadlines of all blocks, then earliest deadline first, slot by slot."""
    weight = "CASE source " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in weights.items()) + f" ELSE {default} END"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '(null)') AS source FROM documents),
     src AS (SELECT source, count(*) AS n, {weight} AS w, (count(*) + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} AS blocks FROM d GROUP BY source),
     cut AS (SELECT v, max_by(p, -q) AS p, min(q) AS q FROM (SELECT p / q AS v, p, q FROM (
         SELECT 0 AS p, 1 AS q UNION ALL SELECT blocks, w FROM src UNION ALL SELECT blocks // w, 1 FROM src UNION ALL SELECT (blocks + w - 1) // w, 1 FROM src)) WHERE v <= (SELECT max(blocks / w) FROM src) GROUP BY v),
     seg AS (SELECT * FROM (SELECT v AS v0, p AS p0, q AS q0, lead(v) OVER o AS v1, lead(p) OVER o AS p1, lead(q) OVER o AS q1 FROM cut WINDOW o AS (ORDER BY v)) WHERE v1 IS NOT NULL),
     giv AS (SELECT v0, source, w, blocks, CASE WHEN q0 = 1 AND q1 = 1 THEN p1 - p0 ELSE 1 END AS reps, CASE WHEN blocks / w < v1 THEN 0 WHEN q0 = 1 AND q1 = 1 THEN w ELSE (w * p1) // q1 - (w * p0) // q0 END AS g FROM seg, src),
     len_ AS (SELECT v0, reps, l, coalesce(sum(l * reps) OVER (ORDER BY v0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM (SELECT v0, any_value(reps) AS reps, sum(g) AS l FROM giv GROUP BY v0)),
     due AS (SELECT source, w, coalesce(sum(g * giv.reps) OVER (PARTITION BY source ORDER BY v0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done, g, l, begin, giv.reps,
                    sum((g > 0)::INT) OVER (PARTITION BY v0, w) AS k, row_number() OVER (PARTITION BY v0, w ORDER BY g = 0, blocks DESC, source) - 1 AS m FROM giv JOIN len_ USING (v0)),
     job AS (SELECT source, w, begin + r * l AS round, i * k + m AS x, (done + r * g + i)::BIGINT AS block, (begin + r * l + ((i * k + m) * l) // (k * g))::BIGINT AS release, (begin + r * l + ((i * k + m + 1) * l + k * g - 1) // (k * g))::BIGINT AS deadline
             FROM due, unnest(range(0, reps::BIGINT)) AS a(r), unnest(range(0, g::BIGINT)) AS b(i) WHERE g > 0),
     jobs AS (SELECT list({{'deadline': deadline, 'source': source, 'block': block, 'release': release}} ORDER BY deadline, w DESC, round, x) AS todo, count(*) AS n FROM job),
     run AS (SELECT -1::BIGINT AS slot, NULL::STRUCT(deadline BIGINT, source VARCHAR, block BIGINT, "release" BIGINT) AS pick, todo, n FROM jobs
             UNION ALL SELECT slot + 1, list_filter(todo, lambda x: x.release <= slot + 1)[1], list_filter(todo, lambda x: x <> list_filter(todo, lambda y: y.release <= slot + 1)[1]), n FROM run WHERE slot + 1 < n),
     placed AS (SELECT pick.source AS source, pick.block AS block, slot FROM run WHERE slot >= 0),
     ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS k FROM d)
SELECT doc_id, source, (k // {BLOCK_ROWS})::BIGINT AS block, slot, row_number() OVER (ORDER BY slot, k) - 1 AS position
FROM ranked JOIN placed USING (source) WHERE k // {BLOCK_ROWS} = block"""


def _nibbles() -> str:
    """CRC-32 (polynomial 0xEDB88320, reflected) of the sixteen 4-bit values, as a SQL list."""
    out = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return f"(CAST({out} AS BIGINT[]))"


def sharding(shards: int) -> str:
    """Smallest capacity by bisection with a greedy fill in each step."""
    fill = "list_reduce(bs, lambda s, x: CASE WHEN x > {c} THEN {{'k': 1000000::BIGINT, 'at': 0::BIGINT}} WHEN s.at + x > {c} THEN {{'k': s.k + 1, 'at': x}} ELSE {{'k': s.k, 'at': s.at + x}} END, {{'k': 1::BIGINT, 'at': 0::BIGINT}})"
    return f"""
WITH RECURSIVE r AS (SELECT doc_id, text, strlen(coalesce(text, '')) + 1 AS size FROM documents),
     crc AS (SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, flat), lambda c, b: xor(c >> 4, {_nibbles()}[(xor(c, b) & 15) + 1])), 4294967295) AS crc
             FROM (SELECT text, list_transform(regexp_extract_all(regexp_replace(hex(coalesce(text, '')), '(.)(.)', '\\2\\1', 'g'), '.'), lambda h: ('0x' || h)::BIGINT) AS flat FROM (SELECT DISTINCT text FROM r))),
     g AS (SELECT text, min(doc_id) AS o, sum(size)::BIGINT AS b FROM r GROUP BY text),
     a AS (SELECT list(b ORDER BY o) AS bs, sum(b)::BIGINT AS total FROM g),
     c AS (SELECT bs, 0::BIGINT AS low, total AS high FROM a
           UNION ALL SELECT bs, CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END FROM (SELECT bs, low, high, (low + high) // 2 AS mid, {fill.format(c='((low + high) // 2)')}.k <= {shards} AS ok FROM c WHERE high - low > 1)),
     cap AS MATERIALIZED (SELECT min(high) AS cap FROM c),
     o AS MATERIALIZED (SELECT text, o, b, row_number() OVER (ORDER BY o) AS n FROM g),
     f AS (SELECT 1::BIGINT AS n, 0 AS shard, b AS at FROM o WHERE n = 1
           UNION ALL SELECT o.n, CASE WHEN f.at + o.b > cap THEN shard + 1 ELSE shard END, CASE WHEN f.at + o.b > cap THEN o.b ELSE f.at + o.b END FROM f JOIN o ON o.n = f.n + 1, cap)
SELECT doc_id, r.size::BIGINT AS size, crc.crc::BIGINT AS text_crc32, 'bytes' AS law, f.shard::INT AS shard, row_number() OVER (PARTITION BY f.shard ORDER BY o.o, doc_id) - 1 AS slot, NULL::INT AS grown_shard
FROM r JOIN o ON r.text IS NOT DISTINCT FROM o.text JOIN f ON f.n = o.n JOIN crc ON r.text IS NOT DISTINCT FROM crc.text"""


def periodic_runs(min_length: int = 6, exponent: int = 4) -> str:
    """Equal words at each distance, their unbroken stretches, and of equal stretches the smallest distance."""
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS o, xor(list_reduce(list_prepend(4294967295::BIGINT, flat), lambda c, b: xor(c >> 4, {_nibbles()}[(xor(c, b) & 15) + 1])), 4294967295)::BIGINT AS h
           FROM (SELECT *, list_transform(regexp_extract_all(regexp_replace(hex(doc_id::VARCHAR), '(.)(.)', '\\2\\1', 'g'), '.'), lambda x: ('0x' || x)::BIGINT) AS flat FROM documents)),
     g AS (SELECT *, len(o) AS n, (h // 10) % greatest(len(o), 1) AS a, 3 + (h // 10) % 8 AS e FROM t),
     d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: o[(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // e) END) + 1]) ELSE o END AS w FROM g),
     v AS (SELECT doc_id, n, i, w[i + 1] AS x FROM d, unnest(range(0, n)) AS u(i)),
     p AS (SELECT l.doc_id, r.i - l.i AS q, l.i FROM v l JOIN v r ON l.doc_id = r.doc_id AND l.x = r.x AND r.i > l.i AND (r.i - l.i) * {exponent} <= l.n),
     s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM p),
     m AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, k HAVING count(*) + q >= greatest({min_length}, {exponent} * q)),
     r AS (SELECT doc_id, start, length, min(q) AS period FROM m GROUP BY ALL),
     b AS (SELECT doc_id, count(*) AS n_runs, first({{'start': start, 'length': length, 'period': period}} ORDER BY length DESC, start, period) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id),
     gone AS (SELECT DISTINCT doc_id, i FROM r, unnest(range(start + period, start + length)) AS u(i)),
     c AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM v ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period, (1000 * best.length // best.period)::BIGINT AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)"""
