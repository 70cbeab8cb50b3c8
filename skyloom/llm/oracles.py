"""SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from . import quality as q

_W = r"[^\x20\x09-\x0D]+"

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_W}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
c AS (SELECT *, len(ws) AS n_words, array_to_string(ws, '') AS j, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM w),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS k FROM (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS x FROM (SELECT rid, ws, unnest(range(1, n_words - 3)) AS i FROM c WHERE n_words >= 5))),
rep AS (SELECT rid, count(DISTINCT i + s) AS n FROM win, range(5) r(s) WHERE k > 1 GROUP BY 1),
b AS (SELECT c.*, coalesce(rep.n, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(rep.n, 0) > 20 * n_words AS base_failed,
  length(j) - length(regexp_replace(j, '[\pL\p{{Nl}}]', '', 'g')) AS a, length(j) - length(regexp_replace(j, '[\p{{Lu}}\p{{Lt}}]', '', 'g')) AS u,
  length(j) - length(regexp_replace(j, '[0-9]', '', 'g')) AS g, length(j) - length(regexp_replace(j, '[.,;:!?''"()-]', '', 'g')) AS s FROM c LEFT JOIN rep USING (rid)),
tok AS (SELECT rid, lang, unnest(ws) AS x FROM c),
top AS (SELECT lang, x FROM (SELECT lang, x, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, x) AS k FROM tok WHERE length(x) <= {q.COMMON_LETTERS} GROUP BY lang, x) WHERE k <= {q.COMMON_WORDS}),
hit AS (SELECT rid, lang, x, count(*) AS n FROM tok SEMI JOIN top USING (lang, x) GROUP BY ALL),
bins AS (
  SELECT rid, lang, 'w' AS kind, '_' || x AS bin, coalesce(hit.n, 0)::DOUBLE AS n FROM b JOIN top USING (lang) LEFT JOIN hit USING (rid, lang, x)
  UNION ALL SELECT rid, b.lang, 'w', 'rest', (n_words - coalesce(h.n, 0))::DOUBLE FROM b LEFT JOIN (SELECT rid, sum(n) AS n FROM hit GROUP BY 1) h USING (rid)
  UNION ALL SELECT rid, lang, 'c', v.bin, v.n::DOUBLE FROM b, LATERAL (SELECT unnest(['u', 'l', 'd', 's', 'y', 'o', 'w']) AS bin, unnest([u, a - u, g, s, n_symbols, greatest(0, length(j) - a - g - s - n_symbols), length(t) - length(j)]) AS n) v),
refs AS (SELECT lang, kind, bin, n / greatest(1.0, sum(n) OVER (PARTITION BY lang, kind)) AS p, sum(n) OVER (PARTITION BY lang, kind) AS total FROM (SELECT lang, kind, bin, sum(n) AS n FROM bins GROUP BY ALL)),
own AS (SELECT lang FROM refs WHERE kind = 'w' AND lang <> '' GROUP BY lang HAVING max(total) >= {q.REFERENCE_WORDS}),
held AS (SELECT * FROM refs SEMI JOIN own USING (lang) UNION ALL SELECT l.lang, 'c', bin, p, NULL FROM (SELECT DISTINCT lang FROM b ANTI JOIN own USING (lang)) l, (SELECT bin, sum(n) / greatest(1.0, sum(sum(n)) OVER ()) AS p FROM bins WHERE kind = 'c' GROUP BY bin)),
dist AS (SELECT rid, kind, sqrt(least(1.0, greatest(0.0, sum(CASE WHEN x > 0 THEN x * log2(x / ((x + p) / 2)) ELSE 0 END + CASE WHEN p > 0 THEN p * log2(p / ((x + p) / 2)) ELSE 0 END) / 2))) AS v
  FROM (SELECT rid, bins.lang, kind, bin, CASE WHEN sum(n) OVER (PARTITION BY rid, kind) > 0 THEN n / sum(n) OVER (PARTITION BY rid, kind) END AS x FROM bins) e JOIN held USING (lang, kind, bin) GROUP BY 1, 2)
SELECT doc_id, n_words, length(j) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (n_words < {q.CHAR_GUARD} OR coalesce(dc.v, 0) <= {q.CHAR_DISTANCE}) AND (n_words < {q.WORD_GUARD} OR coalesce(dw.v, 0) <= {q.WORD_DISTANCE}) AS kept
FROM b LEFT JOIN dist dc ON dc.rid = b.rid AND dc.kind = 'c' LEFT JOIN dist dw ON dw.rid = b.rid AND dw.kind = 'w'
"""

_BASE32 = "array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, g * 5 + 1, 5))::BIGINT >> (15 - 5 * k)) & 31)::BIGINT + 1, 1)), '')), '')"

OP4 = f"""
SELECT page_id, bytes AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, '')) AS bytes, sha1(coalesce(html, '')) AS sha, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
"""

_ORDER = "ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST"

OP10 = rf"""
WITH r AS (SELECT conv_id, turn, role AS r0, text AS t0, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
  SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')))
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' {_ORDER}) AS said, coalesce(string_agg(text, '' {_ORDER}) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum(24 + length(role) + length(regexp_replace(role, '[^\\<"\n]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<]', '', 'g'))) AS BIGINT) AS formatted_chars
  FROM r GROUP BY conv_id)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SAME = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

# Exact in HUGEINT; pieces and words as lists, windows by slices.
OP11 = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_SAME}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
grams AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) r(k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(a)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND a >= 100),
cut AS (SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, n.n, (1000::HUGEINT * c.a * n.n) // (x.a * y.a) AS score, row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000::HUGEINT * c.a * n.n) // (x.a * y.a), g.j) AS place
  FROM c JOIN range(1, 5) g(j) ON g.j < c.k JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:g.j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[g.j + 1:], ' ') JOIN n ON n.lang = c.lang),
inner_ AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS i FROM c JOIN range(2, 5) r(m) ON m < k) GROUP BY 1, 2),
best AS (SELECT cut.*, row_number() OVER (PARTITION BY cut.lang ORDER BY score DESC, cut.a DESC, encode(cut.phrase)) AS rank FROM cut LEFT JOIN inner_ USING (lang, phrase) WHERE place = 1 AND (longer IS NULL OR 100 * longer < 100 * cut.a))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM best WHERE rank <= 2000
"""

_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_SAME}, '{_ITEM_WORD}') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, ws, least(len(ws), 10) AS k FROM (SELECT item_id, regexp_extract_all({_SAME}, '{_ITEM_WORD}') AS ws FROM benchmark) WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM b)),
own AS (SELECT rid, k, i, array_to_string(ws[i:i + k - 1], ' ') AS x FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(ws) >= k)),
hit AS (SELECT rid, i, k, item FROM own JOIN win USING (k, x)),
words AS (SELECT rid, count(DISTINCT i + s) AS n FROM hit JOIN range(10) r(s) ON s < k GROUP BY 1),
items AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY encode(item)) AS listed FROM (SELECT DISTINCT rid, item FROM hit WHERE item IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

# CRC-32 by a table that its rule gives; near words by the words that are left without one character.
OP13 = f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_SAME}, '[A-Za-z\u00c0-\u00ff]+')) AS run FROM documents),
each AS (SELECT id || ':' || run AS key, hex(encode(id || ':' || run)) AS hx, run, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, k, xor(list_reduce([4294967295] || list_transform(range(strlen(key)), lambda i: CAST('0x' || substr(hx, CAST(2 * i + 1 AS INT), 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INT)])), 4294967295) AS h FROM each, tab),
said AS (SELECT k, CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM said WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
less AS (SELECT word, n, length(word) AS m, i, substr(word, 1, i - 1) || substr(word, i + 1) AS x FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INT) AS i FROM words)),
near AS (
  SELECT p.word, q.word AS other, q.n AS other_n FROM less p JOIN less q USING (m, i, x) WHERE p.word <> q.word
  UNION SELECT p.word, q.word, q.n FROM words p JOIN less q ON q.x = p.word
  UNION SELECT q.word, p.word, p.n FROM words p JOIN less q ON q.x = p.word),
best AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM near),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 5 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 5 * w.n THEN b.other_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1),
chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NOT NULL),
ends AS (SELECT chain.word, root FROM chain JOIN forms ON forms.word = root WHERE forms.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN ends USING (word)
"""
