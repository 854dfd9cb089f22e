"""Oracle SQL (DuckDB) of the corpus queries that it can express.

The statements restate the contracts in plain SQL, window by window and pair by pair; they take ids
as unique, as the driver's tables have them.
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Words covered by a window of 35 words that occurs more than once.
SUBSTRING = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 34, 0))) AS i FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 35], ' ') AS k FROM s),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM rep, range(0, 35) t(j)),
every AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d),
kept AS (SELECT e.doc_id, count(g.p) AS n_removed, string_agg(e.word, ' ' ORDER BY e.p) FILTER (WHERE g.p IS NULL) AS text
  FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(kept.n_removed, 0) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""

#: Bytes covered by a string of 100 bytes that also starts earlier; bytes are pairs of hexadecimal digits.
SUFFIX = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
every AS (SELECT doc_id, unnest(range(0, CAST(length(h) / 2 AS BIGINT))) AS p, h FROM d),
win AS (SELECT doc_id, p, substring(h, 2 * p + 1, 2) AS byte,
  CASE WHEN 2 * p + 200 <= length(h) THEN md5(substring(h, 2 * p + 1, 200)) END AS k FROM every),
later AS (SELECT doc_id, p, byte, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1 AS again FROM win),
cov AS (SELECT doc_id, p, byte, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), false) AS gone FROM later),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS starts FROM cov),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans,
  string_agg(byte, '' ORDER BY p) FILTER (WHERE NOT gone) AS h FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) / 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""

#: Links of all pairs by their sets of five words; classes by following links.
NGRAM_JOIN = f"""WITH RECURSIVE d AS (SELECT doc_id, text, {_WORDS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS g FROM (
  SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT pair.a, pair.b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
class AS (SELECT a AS doc_id, min(b) AS class_id, count(*) AS class_size FROM reach GROUP BY a)
SELECT class.doc_id, class_id, class_size, (SELECT count(*) FROM link WHERE link.a = class.doc_id) AS n_links,
  (SELECT count(DISTINCT md5(t.text)) FROM link JOIN d t ON t.doc_id = link.b JOIN d s ON s.doc_id = link.a
   WHERE link.a = class.doc_id AND t.text <> s.text) AS n_text_links FROM class"""

#: Hard negatives by scoring every anchor against every row.
HARD_NEGATIVES = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""

#: Phrases by listing all n-grams of all pieces; every cut and every longer candidate is looked at.
COLLOCATIONS = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM s, range(1, 6) t(m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, phrase, m, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT * FROM f WHERE m >= 2),
cut AS (SELECT c.lang, c.phrase, c.a, k, array_to_string(string_split(c.phrase, ' ')[1:k], ' ') AS x,
  array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ') AS y FROM c, range(1, 5) t(k) WHERE k < m),
sc AS (SELECT cut.lang, cut.phrase, cut.a, cut.k, f1.a AS l, f2.a AS r, n.n,
  CAST((1000::HUGEINT * cut.a * n.n) // (f1.a::HUGEINT * f2.a) AS BIGINT) AS score
  FROM cut JOIN f f1 ON f1.lang = cut.lang AND f1.phrase = x JOIN f f2 ON f2.lang = cut.lang AND f2.phrase = y JOIN n ON n.lang = cut.lang),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
gone AS (SELECT DISTINCT b.lang, b.phrase FROM c b JOIN c o ON o.lang = b.lang AND o.m > b.m AND 100 * o.a >= 100 * b.a
  AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ')),
ranked AS (SELECT best.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best ANTI JOIN gone USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""
