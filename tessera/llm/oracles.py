"""SQL for the queries that SQL can express; all of it runs over whole tables and whole texts."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
ITEM_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), '" + UPPER + "', '" + LOWER + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

REPEATS = f"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS words FROM documents),
windows AS (SELECT doc_id, i, words[i:i + 12] AS seq FROM w, unnest(range(1, len(words) - 11)) t(i)),
firsts AS (SELECT seq, min(doc_id) AS least FROM windows GROUP BY seq),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN firsts USING (seq), range(13) r(k) WHERE least < doc_id),
each AS (SELECT doc_id, p, words[p] AS word FROM w, unnest(range(1, len(words) + 1)) t(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {ITEM_WORDS.format("text")} AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {ITEM_WORDS.format("text")} AS words FROM benchmark),
items AS (SELECT DISTINCT item, least(13, len(words)) AS size, words[i:i + least(13, len(words)) - 1] AS seq FROM b, unnest(range(1, len(words) - least(13, len(words)) + 2)) t(i) WHERE len(words) > 0),
windows AS (SELECT doc_id, size, i, words[i:i + size - 1] AS seq FROM d, (SELECT DISTINCT size FROM items) s, unnest(range(1, len(words) - size + 2)) t(i)),
found AS (SELECT doc_id, windows.size, i, item FROM windows JOIN items ON windows.seq = items.seq),
hits AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM found, unnest(range(size)) t(k) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(words) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

COMPONENTS = """
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT a, b FROM ends UNION SELECT r.id, ends.b FROM reach r JOIN ends ON r.other = ends.a)
"""

NEAR_COPIES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), '" + UPPER + "', '" + LOWER + "')")} AS words FROM documents),
sets AS (SELECT DISTINCT doc_id, words[i:i + 4] AS shingle FROM w, unnest(range(1, greatest(len(words) - 4, 1) + 1)) t(i) WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared.n >= 75 * (p.n + q.n - shared.n)),
{COMPONENTS},
smallest AS (SELECT id, min(other) AS other FROM reach GROUP BY id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(other, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(other, w.doc_id)) AS kept
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN smallest ON smallest.id = w.doc_id
"""

EMBEDDING_COPIES = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
{COMPONENTS},
degree AS (SELECT a AS id, count(*) AS n FROM ends GROUP BY a),
smallest AS (SELECT id, min(other) AS other FROM reach GROUP BY id)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(other, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(other, vec_id)) AS kept
FROM embeddings LEFT JOIN degree ON degree.id = vec_id LEFT JOIN smallest ON smallest.id = vec_id
"""


SPELLING = f"""
WITH t AS (SELECT list_transform(range(256), lambda c: list_reduce(list_prepend(c, range(8)), lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)) AS crc),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS times FROM r GROUP BY ALL),
b AS (SELECT *, list_transform(string_split(concat(doc_id, ':', run), ''), lambda x: ord(x)) AS points FROM d),
h AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(points, lambda p: CASE WHEN p < 128 THEN [p] ELSE [195, p - 64] END))), lambda s, c: xor(crc[(xor(s, c) & 255) + 1], s >> 8)), 4294967295) AS hash FROM b, t),
e AS (SELECT CASE WHEN hash % 97 = 0 THEN substr(run, 1, CAST(hash % length(run) AS BIGINT)) || substr(run, CAST(hash % length(run) AS BIGINT) + 2) ELSE run END AS word, times FROM h),
w AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM e WHERE length(word) >= 5 GROUP BY 1 HAVING sum(times) >= 3),
g AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM w, unnest(range(1, length(word) + 1)) x(i)),
p AS (SELECT a.word AS a, b.word AS b FROM g a JOIN g b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word FROM g a JOIN w b ON a.rest = b.word UNION SELECT b.word, a.word FROM g a JOIN w b ON a.rest = b.word),
q AS (SELECT p.a AS word, count(*) AS near, max(w.n) AS best FROM p JOIN w ON p.b = w.word GROUP BY 1),
f AS (SELECT p.a AS word, min(p.b) AS form FROM p JOIN w ON p.b = w.word JOIN q ON q.word = p.a AND q.best = w.n GROUP BY 1),
o AS (SELECT w.word, CASE WHEN best >= 2 * n THEN form END AS form, n, coalesce(near, 0) AS n_near, CASE WHEN best >= 2 * n THEN best END AS form_n FROM w LEFT JOIN q USING (word) LEFT JOIN f USING (word)),
s(word, root) AS (SELECT word, word FROM o UNION ALL SELECT s.word, o.form FROM s JOIN o ON o.word = s.root WHERE o.form IS NOT NULL),
z AS (SELECT s.word, s.root FROM s JOIN o ON o.word = s.root WHERE o.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM o JOIN z USING (word)
""".replace("WITH t", "WITH RECURSIVE t", 1)

COLLOCATIONS = f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM t),
total AS (SELECT lang, CAST(sum(len(words)) AS HUGEINT) AS n FROM p GROUP BY 1),
g AS (SELECT lang, words[i:i + k - 1] AS ws, k FROM p, (SELECT unnest(range(1, 6)) AS k), unnest(range(1, len(words) - k + 2)) x(i)),
f AS (SELECT lang, ws, k, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT c.lang, c.ws, c.k, c.f AS a, cut, x.f AS l, y.f AS r, (1000 * c.f * n) // (x.f * y.f) AS score
  FROM f c JOIN total USING (lang), unnest(range(1, c.k)) u(cut) JOIN f x ON x.lang = c.lang AND x.ws = c.ws[1:cut] JOIN f y ON y.lang = c.lang AND y.ws = c.ws[cut + 1:]),
least AS (SELECT *, row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) AS place FROM cuts),
parts AS (SELECT DISTINCT b.lang, b.ws[i:i + m - 1] AS ws, b.f FROM f b, unnest(range(2, b.k)) w(m), unnest(range(1, b.k - m + 2)) v(i)),
gone AS (SELECT DISTINCT s.lang, s.ws FROM f s JOIN parts p ON p.lang = s.lang AND p.ws = s.ws AND 100 * p.f >= 100 * s.f),
kept AS (SELECT * FROM least ANTI JOIN gone USING (lang, ws) WHERE place = 1),
ranked AS (SELECT *, array_to_string(ws, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) AS rank FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

ORACLES = {"op1_repeats": REPEATS, "op5_decontaminate": CONTAMINATION, "op6_embedding_copies": EMBEDDING_COPIES, "op8_near_copies": NEAR_COPIES, "op11_spelling": SPELLING, "op12_collocations": COLLOCATIONS}
