"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL = {
    "op1_substring_dedup": rf"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
wins AS (SELECT doc_id, i, list_aggregate(w[i:i+49], 'string_agg', ' ') AS win
         FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM docs WHERE len(w) >= 50)),
least AS (SELECT win, min(doc_id) AS least FROM wins GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM wins JOIN least USING (win) WHERE doc_id > least),
lists AS (SELECT doc_id, list(p) AS ats FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, len(w) AS n, coalesce(len(ats), 0) AS n_removed,
                list_filter(w, lambda x, i: NOT coalesce(list_contains(ats, i), false)) AS k
         FROM docs LEFT JOIN lists USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
       sha256(coalesce(list_aggregate(k, 'string_agg', ' '), '')) AS kept_sha256
FROM kept
""",
    "op3_decontamination": r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS size FROM items WHERE len(w) > 0),
iwin AS (SELECT DISTINCT item_id, size, list_aggregate(w[i:i + size - 1], 'string_agg', ' ') AS win
         FROM (SELECT item_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM sized)),
sizes AS (SELECT DISTINCT size FROM iwin),
dwin AS (SELECT doc_id, i, size, list_aggregate(w[i:i + size - 1], 'string_agg', ' ') AS win
         FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM low, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, i, iwin.size AS size, item_id FROM dwin JOIN iwin ON dwin.win = iwin.win AND dwin.size = iwin.size),
words AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT low.doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(ids.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM low LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
""",
    "op9_line_dedup": r"""
WITH lines AS (SELECT doc_id, l, i,
                      trim(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
               FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
                            generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
often AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(often.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE often.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN often ON lines.k = often.k GROUP BY doc_id
""",
    "op6_minhash_dedup": r"""
WITH RECURSIVE low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(list_aggregate(w[i:i + least(len(w), 5) - 1], 'string_agg', ' '), least(len(w), 5)) AS s
       FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM low WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM low UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.doc_id),
comp AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT low.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, low.doc_id = component_id AS kept
FROM low JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op7_quality_rules": rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
wins AS (SELECT doc_id, i, list_aggregate(w[i:i+4], 'string_agg', ' ') AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM docs WHERE len(w) >= 5)),
twice AS (SELECT doc_id, win FROM wins GROUP BY ALL HAVING count(*) >= 2),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 4)) AS p FROM wins JOIN twice USING (doc_id, win)) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(t, '[^A-Z\x{{C0}}-\x{{DE}}]', '', 'g')) AS n_upper,
             length(regexp_replace(t, '[^A-Za-z\x{{C0}}-\x{{10FFFF}}]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaim
      FROM docs LEFT JOIN covered USING (doc_id)),
ledger AS (SELECT *, ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (n_symbols > n_words)::BIGINT
                      + 8 * (2 * n_dup_lines > n_lines AND n_dup_lines >= 10)::BIGINT + 16 * (word_chars > 40 * n_words)::BIGINT
                      + 32 * (10 * n_upper > 7 * n_letters AND n_letters >= 40)::BIGINT + 64 * (2 * n_exclaim > n_words AND n_words >= 10)::BIGINT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM ledger
""",
    "op11_hard_negatives": r"""
WITH own AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
             FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS a, a.label AS la, b.vec_id AS b, b.label AS lb, list_inner_product(a.v, b.v)::BIGINT AS s
           FROM own a JOIN own b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT a, b AS p, s AS ps FROM scored WHERE la = lb QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
neg AS (SELECT pos.a, p, ps, b, s, row_number() OVER (PARTITION BY pos.a, p ORDER BY s DESC, b) AS rank
        FROM pos JOIN scored USING (a) WHERE la <> lb AND 80 * ps <= 100 * s AND 100 * s <= 100 * ps)
SELECT a AS anchor_id, p AS positive_id, rank::INTEGER AS rank, b AS negative_id, ps AS positive_score, s AS negative_score FROM neg WHERE rank <= 5
""",
    "op13_filter_audit": rf"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
bits AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
                + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
                + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
         FROM docs LEFT JOIN marks USING (doc_id)),
hist AS (SELECT part, mask, count(*) AS n, count_if(good) AS g, count_if(toxic) AS x FROM bits GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
           FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, i::INT AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i-1]), 0)::INT AS before FROM orders, generate_series(1, 5) AS g(i)),
made AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
                sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
                sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
                sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN g ELSE 0 END)::BIGINT AS good_lost,
                sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN x ELSE 0 END)::BIGINT AS toxic_lost
         FROM hist, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM made
""",
}
