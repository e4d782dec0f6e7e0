"""SQL of the operators that SQL can express, for the driver's side-by-side check."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END g FROM d),
 e AS (SELECT doc_id, len(g) n, unnest(g) g FROM s),
 p AS (SELECT a.doc_id a, b.doc_id b, a.n na, b.n nb, count(*) k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
 m AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 r(a, b) AS (SELECT a, a FROM m UNION SELECT r.a, m.b FROM r JOIN m ON r.b = m.a),
 c AS (SELECT a doc_id, min(b) component_id FROM r GROUP BY 1)
 SELECT s.doc_id, len(g) n_shingles, coalesce(component_id, s.doc_id) component_id, coalesce(component_id, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN c USING (doc_id)"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

OP9 = f"""WITH d AS (SELECT doc_id, {_WORDS} w FROM documents),
 b AS (SELECT CAST(item_id AS VARCHAR) item, {_WORDS} w FROM benchmark),
 bi AS (SELECT item, w, least(13, len(w)) n, unnest(range(1, len(w) - least(13, len(w)) + 2)) i FROM b WHERE len(w) > 0),
 bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') g FROM bi),
 di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, (SELECT DISTINCT n FROM bw) x WHERE len(w) >= n),
 m AS (SELECT doc_id, bw.n, i, item FROM di JOIN bw ON di.n = bw.n AND array_to_string(w[i:i + di.n - 1], ' ') = bw.g),
 h AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM m) q GROUP BY 1),
 t AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) s FROM (SELECT DISTINCT doc_id, item FROM m) q GROUP BY 1)
 SELECT d.doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(s, '')) items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP10 = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) payload_bytes, sha1(coalesce(html, '')) h FROM pages), l AS (SELECT h, max(page_id) last FROM p GROUP BY 1)
 SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31) AS BIGINT), 1)), '') payload_digest,
 CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END record_type, CASE WHEN page_id <> last THEN last END refers_to FROM p JOIN l USING (h)"""

#: CRC-32 of a list of byte values, by the 256 entries of ``crc_table``, which stands beside.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295)"""

_CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) t FROM (SELECT i, list_reduce(list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) v FROM range(256) x(i)) y)"""

#: A run of four periods has at least two multiples of its period whose word and next multiple's word agree, one after the other.
OP12 = rf"""WITH {_CRC_TABLE},
 d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)) b FROM documents),
 h AS (SELECT doc_id, w, len(w) n, {_CRC.format(bytes='b')} h FROM d, crc_table),
 g AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END a, (h // 10) % 8 e FROM h),
 p AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE w[1:a] || list_transform(range(n - a), lambda i: w[a + 1 + i % (1 + (n - a) // (3 + e))]) END w FROM g),
 k AS (SELECT doc_id, n, q, unnest(list_filter(range(0, n, q), lambda i: i + 2 * q < n AND w[i + 1] = w[i + q + 1] AND w[i + q + 1] = w[i + 2 * q + 1])) i FROM (SELECT *, unnest(range(1, n // 4 + 1)) q FROM p) x),
 c AS (SELECT DISTINCT doc_id, q FROM k),
 m AS (SELECT doc_id, q, unnest(list_filter(range(n - q), lambda i: w[i + 1] = w[i + q + 1])) i FROM c JOIN p USING (doc_id)),
 s AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) o, i FROM m),
 r AS (SELECT doc_id, min(i) start, count(*) + q length, q period FROM s GROUP BY doc_id, q, o HAVING count(*) + q >= greatest(6, 4 * q)),
 u AS (SELECT doc_id, start, length, min(period) period FROM r GROUP BY doc_id, start, length),
 t AS (SELECT doc_id, count(*) n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) lines,
  min({{'l': -length, 's': start, 'p': period}}) most FROM u GROUP BY 1),
 x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) i FROM u),
 y AS (SELECT doc_id, list(i) gone FROM x GROUP BY 1),
 z AS (SELECT p.doc_id, string_agg(w[i + 1], ' ' ORDER BY i) kept FROM (SELECT doc_id, w, unnest(range(n)) i FROM p) p ANTI JOIN x ON p.doc_id = x.doc_id AND p.i = x.i GROUP BY 1)
 SELECT p.doc_id, coalesce(n_runs, 0) n_runs, most.s start, -most.l length, most.p period, (1000 * -most.l) // most.p exponent_milli, sha256(coalesce(lines, '')) runs_sha256, sha256(coalesce(kept, '')) collapsed_sha256
 FROM p LEFT JOIN t USING (doc_id) LEFT JOIN z USING (doc_id)"""

OP13 = rf"""WITH {_CRC_TABLE},
 d AS (SELECT doc_id, {_WORDS} w FROM documents), i AS (SELECT {_WORDS} w FROM benchmark),
 dg AS (SELECT doc_id, array_to_string(w[j:j + k - 1], ' ') g, count(*) m FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) j FROM d, (SELECT unnest([1, 2, 3]) k) y) x GROUP BY 1, 2),
 ig AS (SELECT array_to_string(w[j:j + k - 1], ' ') g, count(*) m FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) j FROM i, (SELECT unnest([1, 2, 3]) k) y) x GROUP BY 1),
 f AS (SELECT g, hex(encode(g)) x FROM (SELECT g FROM dg UNION SELECT g FROM ig) y),
 b AS (SELECT g, {_CRC.format(bytes="list_transform(range(0, len(x) // 2), lambda j: CAST('0x' || x[2 * j + 1:2 * j + 2] AS BIGINT))")} % 10000 b FROM f, crc_table),
 s AS (SELECT b, sum(m) s FROM dg JOIN b USING (g) GROUP BY 1), t AS (SELECT b, sum(m) t FROM ig JOIN b USING (g) GROUP BY 1),
 a AS (SELECT r.b, CAST(coalesce(s, 0) AS DOUBLE) s, CAST(coalesce(t, 0) AS DOUBLE) t FROM range(10000) r(b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
 o AS (SELECT b, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) gain FROM a),
 v AS (SELECT doc_id, CAST(sum(m) AS BIGINT) n_features, CAST(sum(m * gain) AS BIGINT) weight FROM dg JOIN b USING (g) JOIN o USING (b) GROUP BY 1),
 e AS (SELECT doc_id, len(w) n_words, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) score FROM d LEFT JOIN v USING (doc_id)),
 k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) r, 5 * count(*) OVER () // 100 most FROM e WHERE n_words >= 20)
 SELECT doc_id, n_features, weight, score, CASE WHEN r <= most THEN r END AS rank FROM e LEFT JOIN k USING (doc_id)"""

ORACLES = {"op12_periodic_runs": OP12, "op13_importance_resampling": OP13, "op4_minhash_near_dedup": OP4, "op9_benchmark_decontamination": OP9, "op10_warc_salvage": OP10}
