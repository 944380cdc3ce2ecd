"""DuckDB SQL for the queries of registry.py that SQL can express, over whole tables and texts."""

#: Words of a text after folding A-Z; DuckDB's lower() folds more, so letters are translated.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
FOLDED = WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")

OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {FOLDED} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS sh
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)),
g AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, g.y FROM r JOIN g ON g.x = r.u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id,
       CASE WHEN coalesce(n.n, 0) = 0 THEN 1 ELSE c.n_copies END::BIGINT AS n_copies
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(u) AS component_id FROM r GROUP BY v) m ON m.v = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) OVER (PARTITION BY fp) AS n_copies FROM (SELECT doc_id, string_agg(sh, chr(10) ORDER BY sh) AS fp FROM s GROUP BY doc_id)) c USING (doc_id)
"""

OP8 = r"""
WITH d AS (SELECT doc_id, coalesce('0' || source, '1') AS src, ('0x' || substr(md5('mix/' || coalesce(doc_id::VARCHAR, 'null') || '/' || coalesce(md5(text), '-') || '/' || coalesce('0' || source, '1')), 1, 12))::BIGINT AS key,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT src, source_size, (row_number() OVER (ORDER BY src) - 1) % 3 + 1.0::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap
      FROM (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src)),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT src, source_size, least(cap, weight * max(CASE WHEN level * weight <= cap THEN level END) OVER ()) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT d.*, sum(size) OVER (PARTITION BY src ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM d),
c AS (SELECT doc_id, size, source_size, target, epochs, greatest(0, least(size, floor(target + 0.5)::BIGINT - epochs * source_size - before))::BIGINT AS cut FROM p JOIN g USING (src))
SELECT doc_id, size, source_size, target, (epochs * size + cut)::BIGINT AS taken, epochs::BIGINT AS epochs, cut FROM c
"""

OP9 = r"""
WITH d AS (SELECT doc_id, coalesce('0' || lang, '1') AS lang, coalesce('0' || source, '1') AS src, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM p) WHERE n > 1),
h AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT doc_id, lang, src, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n.dup, 0)::BIGINT AS n_dup_lines,
             coalesce(h.n, 0)::BIGINT AS n_repeat_words, coalesce(n.n_lines, 0)::BIGINT AS n_lines FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS word_length, CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbols,
             CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines, CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats FROM c),
l AS (SELECT lang, src, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS ratio, unnest([word_length, symbols, dup_lines, repeats])::BIGINT AS x FROM m WHERE NOT base_failed),
s AS (SELECT lang, src, ratio, greatest(length(bin(x)) - 6, 0)::INT AS shift, x FROM l),
v AS (SELECT lang, src, ratio, (((x >> shift) + 1) << shift) - 1 AS x, count(*) AS n FROM s GROUP BY ALL),
k AS (SELECT lang, ratio, x, sum(n) AS n FROM v GROUP BY ALL), z AS (SELECT lang, ratio, sum(n) AS total FROM k GROUP BY ALL),
g AS (SELECT lang, src, ratio, x, sum(w) AS w FROM (SELECT lang, src, ratio, x, 1000 * n AS w FROM v
      UNION ALL SELECT a.lang, a.src, ratio, x, n * 50000 // total FROM (SELECT DISTINCT lang, src FROM v) a JOIN k USING (lang) JOIN z USING (lang, ratio)) GROUP BY ALL),
i AS (SELECT lang, src, ratio, sum(w * x)::HUGEINT // sum(w)::HUGEINT AS mean FROM g GROUP BY ALL),
u AS (SELECT *, sum(w) OVER (PARTITION BY lang, src, ratio ORDER BY x) AS upto, sum(w) OVER (PARTITION BY lang, src, ratio) AS total FROM g),
q AS (SELECT lang, src, min(CASE WHEN ratio = 'word_length' AND 100 * upto >= 95 * total THEN x END) * 115 // 100 AS wh, min(CASE WHEN ratio = 'word_length' AND 100 * upto >= 5 * total THEN x END) * 85 // 100 AS wl,
             min(CASE WHEN ratio = 'symbols' AND 100 * upto >= 75 * total THEN x END) * 2 AS sh, min(CASE WHEN ratio = 'dup_lines' AND 100 * upto >= 95 * total THEN x END) * 2 AS dh,
             min(CASE WHEN ratio = 'repeats' AND 100 * upto >= 95 * total THEN x END) * 2 AS rh FROM u GROUP BY ALL),
o AS (SELECT lang, src, wh, wl, greatest(sh, s.mean) + 1 AS sh, greatest(dh, d.mean) + 1 AS dh, greatest(rh, r.mean) + 1 AS rh FROM q JOIN i s USING (lang, src) JOIN i d USING (lang, src) JOIN i r USING (lang, src)
      WHERE s.ratio = 'symbols' AND d.ratio = 'dup_lines' AND r.ratio = 'repeats'),
e AS (SELECT m.*, wh, wl, (sh * n_words)::DOUBLE / 1000::DOUBLE AS se, (dh * n_lines)::DOUBLE / 1000::DOUBLE AS de, (rh * n_words)::DOUBLE / 1000::DOUBLE AS re FROM m LEFT JOIN o USING (lang, src)),
j AS (SELECT *, concat_ws(',', CASE WHEN word_length > wh OR word_length < wl THEN 'word_length' END, CASE WHEN n_symbols > se + 3::DOUBLE * sqrt(se + 1::DOUBLE) THEN 'symbols' END,
             CASE WHEN n_dup_lines > de + 3::DOUBLE * sqrt(de + 1::DOUBLE) THEN 'dup_lines' END, CASE WHEN n_repeat_words > re + 3::DOUBLE * sqrt(re + 1::DOUBLE) THEN 'repeats' END) AS outside FROM e)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND outside = '' AS kept, outside FROM j
"""

OP5 = r"""
WITH e AS (SELECT conv_id, turn, coalesce(role, '') AS speaker, replace(replace(coalesce(text, ''), '<|', '<\|'), '|>', '|\>') AS body,
                  replace(replace(coalesce(role, ''), '<|', '<\|'), '|>', '|\>') AS shown,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS seq FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM e WHERE speaker <> 'system'),
r AS (SELECT e.*, p.perspective, speaker = p.perspective AS mine,
             CASE WHEN speaker = p.perspective THEN '<|assistant|>' WHEN speaker = 'system' THEN '<|system|>' ELSE '<|user name=' || shown || '|>' END || chr(10) AS head
      FROM e JOIN p ON e.conv_id IS NOT DISTINCT FROM p.conv_id),
t AS (SELECT *, head || body || '<|end|>' || chr(10) AS rendered FROM r),
l AS (SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM t)
SELECT conv_id, perspective, seq, turn, CASE WHEN mine THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
       CASE WHEN NOT mine AND speaker <> 'system' THEN speaker END AS name, rendered, first AS start, (first + length(rendered))::BIGINT AS "end",
       CASE WHEN mine THEN (first + length(head))::BIGINT END AS loss_start, CASE WHEN mine THEN (first + length(rendered) - 1)::BIGINT END AS loss_end, mine::INT AS mask FROM l
"""

#: Of 48 bits of a digest, the draw of a child of weight w: the least wins.
_DRAW = "(-ln((('0x' || substr(md5(k || '/' || {path}), 1, 12))::BIGINT + 0.5) / 281474976710656) / {w})"
_LEVELS = f"""g AS (SELECT *, CASE WHEN {_DRAW.format(path="'0'", w=4.0)} <= {_DRAW.format(path="'1'", w=4.0)} THEN 0 ELSE 1 END AS region,
                 {_DRAW.format(path="'2'", w=1.0)} < least({_DRAW.format(path="'0'", w=4.0)}, {_DRAW.format(path="'1'", w=4.0)}) AS moves FROM d),
h AS (SELECT *, CASE WHEN {_DRAW.format(path="region || '/0'", w=2.0)} <= {_DRAW.format(path="region || '/1'", w=2.0)} THEN 0 ELSE 1 END AS rack FROM g),
f AS (SELECT *, 4 * region + 2 * rack + CASE WHEN {_DRAW.format(path="region || '/' || rack || '/' || (4 * region + 2 * rack)", w=1.0)} <= {_DRAW.format(path="region || '/' || rack || '/' || (4 * region + 2 * rack + 1)", w=1.0)} THEN 0 ELSE 1 END AS shard FROM h)"""
#: The checksum of a text, a byte at a time: of each byte its eight shifts come from a table of 256 numbers.
_BYTES = "list_transform(range(256), lambda n: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, n::BIGINT))"
OP6 = f"""
WITH t AS MATERIALIZED (SELECT {_BYTES} AS t),
x AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS b FROM documents),
c AS (SELECT doc_id, strlen(text)::BIGINT + 1 AS size,
             xor(list_reduce(list_transform(regexp_extract_all(b, '..'), lambda h: ('0x' || h)::BIGINT), lambda a, v: xor(a >> 8, t[xor(a, v) % 256 + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM x, t),
d AS (SELECT *, coalesce('k' || doc_id, 'null') AS k FROM c), {_LEVELS},
s AS (SELECT *, ('0x' || substr(md5('slot/' || coalesce(doc_id::VARCHAR, 'null') || '/' || text_crc32 || '/' || size), 1, 12))::BIGINT AS bits FROM f)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY bits, doc_id, text_crc32, size) - 1 AS slot, CASE WHEN moves THEN 8 ELSE shard END::INT AS grown_shard FROM s
"""

OP11 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, strlen(html)::BIGINT AS n, sha1(html) AS digest FROM p),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) END AS last FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to, true AS intact FROM m
"""

_FIELDS = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
#: The checksum of a string of ASCII characters, which DuckDB has no function for: eight shifts a byte.
_CRC = "xor(list_reduce(list_transform(range(1, strlen({0}) + 1), lambda i: ascii({0}[i])::BIGINT), lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::BIGINT), 4294967295)"
_TEXT = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LOW = f"translate(text, '{UPPER}', '{LOWER}')"
OP12 = f"""
WITH RECURSIVE f AS (SELECT doc_id, source, sha256({_FIELDS} || {_TEXT.format("text")}) AS leaf,
                            CASE WHEN crc % 5 = 0 THEN sha256({_FIELDS} || {_TEXT.format(_LOW)}) ELSE sha256({_FIELDS} || {_TEXT.format("text")}) END AS shown
                     FROM (SELECT *, {_CRC.format("coalesce(doc_id::VARCHAR, '')")} AS crc FROM documents)),
o AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM f),
t AS (SELECT coalesce('1' || source, '0') AS src, 0 AS level, pos AS i, leaf AS node, n FROM o
      UNION ALL SELECT src, level + 1, i // 16, sha256(string_agg(node, '' ORDER BY i)), (n + 15) // 16 FROM t WHERE n > 1 GROUP BY src, level, i // 16, n),
s AS (SELECT src, node AS subroot, row_number() OVER (ORDER BY src) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, pos AS i, subroot AS node, n FROM s
      UNION ALL SELECT level + 1, i // 16, sha256(string_agg(node, '' ORDER BY i)), (n + 15) // 16 FROM u WHERE n > 1 GROUP BY level, i // 16, n),
w AS (SELECT r, level, (o.pos >> (4 * level)::BIGINT) % 16 AS place, run FROM o JOIN (SELECT src, level, i // 16 AS q, list(node ORDER BY i) AS run FROM t WHERE n > 1 GROUP BY ALL) x
        ON x.src = coalesce('1' || source, '0') AND q = o.pos >> (4 * level + 4)::BIGINT
      UNION ALL SELECT r, 100 + level, (s.pos >> (4 * level)::BIGINT) % 16, run FROM o JOIN s ON s.src = coalesce('1' || source, '0')
        JOIN (SELECT level, i // 16 AS q, list(node ORDER BY i) AS run FROM u WHERE n > 1 GROUP BY ALL) x ON q = s.pos >> (4 * level + 4)::BIGINT),
k AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY level) AS step, array_to_string(run[1:place], '') AS a, array_to_string(run[place + 2:], '') AS z FROM w),
p AS (SELECT r, sha256(string_agg(a || z, '' ORDER BY step)) AS proof, max(step) AS steps FROM k GROUP BY r),
g AS (SELECT r, 0 AS step, shown AS node FROM o UNION ALL SELECT g.r, g.step + 1, sha256(a || node || z) FROM g JOIN k ON k.r = g.r AND k.step = g.step + 1),
e AS (SELECT node AS root FROM u WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, node AS folded_root, node = root AS verified
FROM o JOIN s ON s.src = coalesce('1' || source, '0') LEFT JOIN p USING (r) JOIN g ON g.r = o.r AND g.step = coalesce(steps, 0), e
"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l FROM documents),
r AS (SELECT doc_id, text, l, len(l)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(l) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(l) + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS e FROM d),
p AS (SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 100 THEN 'plain' WHEN e < 50 THEN 'spm' ELSE 'psm' END AS form,
             array_to_string(l[1:least(a, b)], '') AS prefix, array_to_string(l[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(l[greatest(a, b) + 1:], '') AS suffix FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p
"""

SQL: dict[str, str] = {"op5_perspective_rotation": OP5, "op6_hash_tree_shards": OP6, "op7_ngram_jaccard_join": OP7, "op8_source_mix": OP8, "op9_adaptive_quality_rules": OP9, "op11_warc_revisits": OP11, "op12_merkle_manifest": OP12, "op13_split_fill_middle": OP13}
