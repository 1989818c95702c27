"""The same queries in DuckDB's SQL."""

from __future__ import annotations

from lectern.functions.text import CONTEXT_STOPWORDS, IN_SCOPE, OUT_OF_SCOPE, REFUSALS, REPORT_STOPWORDS, SEARCH_STOPWORDS
from lectern.operators.prompt import GROUNDING, ROLES
from lectern.operators.quality import COVERED, HEDGES

WS = r"[ \t\n\r\x0B\f]"


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(words)) + "]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _words(x: str, pattern: str, stop: list[str], least: int = 1) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '{pattern}'), lambda w: length(w) >= {least} AND NOT list_contains({_list(stop)}, w))"


def _tokens(x: str) -> str:
    return _words(x, "[a-z0-9]+", SEARCH_STOPWORDS, 2)


def _content(x: str) -> str:
    return f"list_distinct({_words(x, '[a-z]{4,}', REPORT_STOPWORDS)})"


def _context(x: str) -> str:
    return f"list_distinct({_words(x, '[a-z]{3,}', CONTEXT_STOPWORDS)})"


def _overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE END"


SQL: dict[str, str] = {}

SQL["kb_stats"] = """
WITH s AS (SELECT n_chars, CASE WHEN n_chars >= 500 THEN 'completed' WHEN n_chars >= 50 THEN 'processing' ELSE 'failed' END AS status FROM documents)
SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'processing') AS processing,
       count(*) FILTER (status = 'failed') AS failed, CAST(coalesce(sum(n_chars) FILTER (status = 'completed'), 0) AS BIGINT) AS completed_chars FROM s"""
SQL["kb_source_counts"] = "SELECT source, count(*) AS n FROM documents GROUP BY source"
SQL["doc_page"] = "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20"
SQL["list_totals"] = "SELECT lang, source, count(*) AS total FROM documents GROUP BY lang, source"
SQL["visible_rows"] = """
WITH e AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN user_id END AS owner, event_type FROM events)
SELECT event_id, event_type, owner IS NULL AS unowned FROM e WHERE owner = 7 OR owner IS NULL"""
SQL["image_stats"] = "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1"
SQL["report_rates"] = """
WITH r AS (SELECT CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' ELSE 'draft' END AS status, quality = 0 AS edited FROM labels),
c AS (SELECT count(*) AS total, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (edited) AS edited,
             count(*) FILTER (edited AND status IN ('approved', 'rejected')) AS er FROM r)
SELECT total, approved, rejected, edited, coalesce(round(edited / nullif(approved + rejected, 0), 3), 0.0) AS edit_rate,
       coalesce(round(er / nullif(approved + rejected, 0), 3), 0.0) AS edit_rate_reviewed, coalesce(round(approved / nullif(approved + rejected, 0), 3), 0.0) AS approval_rate FROM c"""
SQL["figure_coverage"] = """
WITH j AS (SELECT d.doc_id, l.doc_id AS has FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT count(*) AS documents, count(DISTINCT has) AS covered, count(has) AS captions, coalesce(round(count(DISTINCT has) / nullif(count(*), 0), 3), 0.0) AS coverage FROM j"""
SQL["dedup_anti_join"] = """
WITH n AS (SELECT text, source, min(doc_id) AS doc_id FROM documents GROUP BY text, source)
SELECT doc_id, source FROM n WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = n.text AND n.source = 'src0')"""
SQL["figures_per_document"] = """
SELECT l_orderkey, l_linenumber, n FROM (SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS INTEGER) AS n FROM lineitem) WHERE n <= 3"""
SQL["merge_status"] = """
SELECT d.doc_id, d.lang, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE d.source END AS source FROM documents d LEFT JOIN labels l USING (doc_id)"""
SQL["unlink_deleted"] = """
SELECT c_custkey, CASE WHEN n.n_nationkey IS NULL THEN c_nationkey ELSE -1 END AS c_nationkey FROM customer LEFT JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) n ON n.n_nationkey = c_nationkey"""
SQL["mean_chunks"] = """
WITH c AS (SELECT source, greatest(ceil((n_chars - 50) / 462), 1) AS chunks FROM documents)
SELECT source, round(avg(chunks), 1) AS mean_chunks, avg(chunks) < 8 AS refetch FROM c GROUP BY source"""
SQL["final_text"] = f"""
WITH j AS (SELECT a.conv_id, a.turn, a.text AS draft, b.text AS edited FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2)
SELECT conv_id, turn, CAST(length(coalesce(edited, draft)) AS INTEGER) AS n_chars, coalesce({_strip('edited')} <> {_strip('draft')}, false) AS was_edited FROM j"""

SQL["tokenize"] = f"""
WITH t AS (SELECT doc_id, {_tokens('text')} AS w FROM documents)
SELECT doc_id, CAST(len(w) AS INTEGER) AS n, CAST(len(list_distinct(w)) AS INTEGER) AS n_distinct, w[1] AS first FROM t"""
_INDEX = f"""
tok AS (SELECT doc_id AS id, unnest({_tokens('text')}) AS term FROM documents),
postings AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY id, term),
lengths AS (SELECT id, count(*) AS dl FROM tok GROUP BY id),
freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
size AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths)"""
SQL["bm25_stats"] = f"""
WITH {_INDEX} SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM freq) AS terms, (SELECT max(df) FROM freq) AS most_df, (SELECT CAST(sum(df) AS BIGINT) FROM freq) AS postings FROM size"""
SQL["term_frequencies"] = f"WITH {_INDEX} SELECT id, term, tf, CAST(dl AS INTEGER) AS dl FROM postings JOIN lengths USING (id)"
SQL["document_frequencies"] = f"WITH {_INDEX} SELECT term, df FROM freq"
_HITS = f"""{_INDEX},
terms AS (SELECT DISTINCT item_id AS query_id, unnest({_tokens('text')}) AS term FROM benchmark),
scored AS (
  SELECT query_id, p.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 4) AS bm25_score
  FROM terms JOIN postings p USING (term) JOIN freq USING (term) JOIN lengths l ON l.id = p.id, size GROUP BY query_id, p.id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, id DESC) AS INTEGER) AS rank, id, bm25_score FROM scored WHERE bm25_score > 0)"""
SQL["bm25_topk"] = f"WITH {_HITS} SELECT query_id, rank, id, bm25_score FROM ranked WHERE rank <= 20"
_SALIENT = f"""{_INDEX},
counts AS (SELECT query_id, term, count(*) AS tf FROM (SELECT item_id AS query_id, unnest({_tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
sal AS (SELECT query_id, term, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * (1 + ln(tf)), 4) AS salience FROM counts JOIN freq USING (term), size),
top AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY salience DESC, term DESC) AS INTEGER) AS rank, term, salience FROM sal)"""
SQL["salient_terms"] = f"WITH {_SALIENT} SELECT query_id, rank, term, salience FROM top WHERE rank <= 24"
SQL["document_query"] = f"""
WITH {_SALIENT}, t AS (SELECT query_id, string_agg(term, ' ' ORDER BY rank) AS terms FROM top WHERE rank <= 24 GROUP BY query_id)
SELECT item_id, 'What does it show? ' || coalesce(terms, substring(text, 1, 400)) AS query FROM benchmark LEFT JOIN t ON query_id = item_id"""

_SCORED = """
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1),
s AS (SELECT vec_id, label, round(list_dot_product(embedding::DOUBLE[], (SELECT v FROM q)), 4) AS score FROM embeddings)"""
SQL["vector_topk"] = f"WITH {_SCORED} SELECT vec_id, score FROM s WHERE score >= 0 ORDER BY score DESC, vec_id LIMIT 12"
SQL["vector_topk_filtered"] = f"WITH {_SCORED} SELECT vec_id, label, score FROM s WHERE score >= 0 AND label = 3 ORDER BY score DESC, vec_id LIMIT 12"
SQL["vector_threshold"] = f"WITH {_SCORED} SELECT vec_id, score FROM s WHERE score >= 0.2 ORDER BY score DESC, vec_id LIMIT 48"
SQL["relevance_gate"] = f"WITH {_SCORED} SELECT label, coalesce(max(score) >= 0.35, false) AS relevant FROM s GROUP BY label"

_TURNS = """
h AS (SELECT conv_id AS document_id, CAST(turn AS INTEGER) AS chunk_index, text, round(length(text) / 10000, 4) AS score, conv_id || '/' || turn AS point_id, role FROM conversations),
hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_index) AS INTEGER) AS rank FROM h)"""
SQL["cap_per_document"] = f"WITH {_TURNS} SELECT document_id, chunk_index, score, rank FROM hits WHERE rank <= 3"
_ISLANDS = f"""{_TURNS},
own AS (SELECT * REPLACE (CAST(chunk_index + chunk_index // 2 AS INTEGER) AS chunk_index) FROM hits),
starts AS (SELECT *, CASE WHEN chunk_index = lag(chunk_index) OVER (PARTITION BY document_id ORDER BY chunk_index, rank) + 1 THEN 0 ELSE 1 END AS s FROM own),
isl AS (SELECT *, sum(s) OVER (PARTITION BY document_id ORDER BY chunk_index, rank ROWS UNBOUNDED PRECEDING) AS island FROM starts)"""
SQL["adjacent_islands"] = f"""
WITH {_ISLANDS} SELECT document_id, CAST(island AS BIGINT) AS island, min(chunk_index) AS first, max(chunk_index) AS last, count(*) AS merged, max(score) AS score FROM isl GROUP BY document_id, island"""
SQL["merge_adjacent"] = f"""
WITH RECURSIVE {_ISLANDS},
numbered AS (SELECT document_id, island, chunk_index, text, score, row_number() OVER (PARTITION BY document_id, island ORDER BY chunk_index, text) AS k, count(*) OVER (PARTITION BY document_id, island) AS merged FROM isl),
fold AS (
  SELECT document_id, island, k, text FROM numbered WHERE k = 1
  UNION ALL
  SELECT n.document_id, n.island, n.k,
         f.text || CASE WHEN o.size IS NULL THEN chr(10) || n.text ELSE substring(n.text, o.size + 1) END
  FROM fold f JOIN numbered n ON n.document_id = f.document_id AND n.island = f.island AND n.k = f.k + 1,
       LATERAL (SELECT max(size) AS size FROM (SELECT unnest(range(21, least(length(f.text), length(n.text), 200) + 1)) AS size) WHERE right(f.text, size) = left(n.text, size)) o
),
runs AS (SELECT document_id, island, max(chunk_index) AS chunk_index, max(score) AS score, max(merged) AS merged FROM numbered GROUP BY document_id, island)
SELECT r.document_id, CAST(row_number() OVER (PARTITION BY r.document_id ORDER BY r.score DESC, r.island) AS INTEGER) AS chunk_id, r.chunk_index, r.score, r.merged, sha256(f.text) AS text_sha256
FROM runs r JOIN fold f ON f.document_id = r.document_id AND f.island = r.island AND f.k = r.merged"""
SQL["rerank_order"] = f"""
WITH {_TURNS} SELECT document_id, chunk_index, CAST(row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN role = 'user' THEN score * 2 ELSE 0.0 END DESC, rank) AS INTEGER) AS rank FROM hits"""
SQL["hybrid_candidates"] = f"""
WITH {_TURNS}, near AS (SELECT document_id AS query_id, point_id, score FROM hits WHERE role = 'user')
SELECT * FROM near
UNION ALL
SELECT document_id, point_id, CASE WHEN role = 'assistant' THEN score ELSE 0.0 END FROM hits h WHERE rank <= 3 AND NOT EXISTS (SELECT 1 FROM near n WHERE n.query_id = h.document_id AND n.point_id = h.point_id)"""
_SCOPE = "NOT (" + " OR ".join(f"contains(x, '{w}')" for w in IN_SCOPE) + ") AND regexp_matches(x, '" + "|".join(f"(?:{p})" for p in OUT_OF_SCOPE).replace("'", "''") + "')"
SQL["out_of_scope"] = f"""
WITH t AS (SELECT conv_id, turn, text, {_strip('lower(text)')} AS a, {_strip("lower('What''s the weather? ' || text)")} AS b FROM conversations)
SELECT conv_id, turn, {_SCOPE.replace('(x,', '(a,')} AS out, {_SCOPE.replace('(x,', '(b,')} AS out_with_weather,
       {' OR '.join(f"contains(lower(coalesce(text, '')), '" + r.replace("'", "''") + "')" for r in REFUSALS)} AS refuses FROM t"""

_SPACES = r"\s\x0B\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# One step for each chunk: the state is a separator's level, the place where the chunk begins, the end of the chunk whose tail it begins with, and the ends of the enclosing pieces.
_CHUNKS = rf"""
txt AS (SELECT doc_id, regexp_replace(text, '^[{_SPACES}]+|[{_SPACES}]+$', '', 'g') AS x FROM documents),
step AS (
  SELECT doc_id, 0 AS k, 0 AS lvl, 0::BIGINT AS p, NULL::BIGINT AS old, [length(x)] AS fr, NULL::BIGINT AS a, NULL::BIGINT AS b FROM txt WHERE length(x) > 512
  UNION ALL
  SELECT doc_id, k + 1,
         CASE act WHEN 'pop' THEN lvl - 1 WHEN 'push' THEN lvl + 1 ELSE lvl END,
         CASE act WHEN 'pop' THEN fe + [2, 1, 2, 1][lvl] WHEN 'cut' THEN p + 462 WHEN 'skip' THEN p + size WHEN 'last' THEN fe WHEN 'push' THEN p
           ELSE CASE WHEN e - p > 50 THEN e - length(CASE WHEN regexp_matches(held, '^[^{_SPACES}]*[{_SPACES}]+[^{_SPACES}]') THEN regexp_replace(held, '^[^{_SPACES}]*[{_SPACES}]+', '') ELSE held END) ELSE e + size END END,
         CASE WHEN act = 'emit' AND e - p > 50 THEN e END,
         CASE act WHEN 'pop' THEN fr[1:lvl] WHEN 'push' THEN list_append(fr, CASE WHEN instr(substring(x, q + 1, fe - q), sep) > 0 THEN q + instr(substring(x, q + 1, fe - q), sep) - 1 ELSE fe END) ELSE fr END,
         CASE WHEN act IN ('cut', 'last', 'emit') THEN p END, CASE act WHEN 'cut' THEN least(p + 512, fe) WHEN 'last' THEN fe WHEN 'emit' THEN e END
  FROM (SELECT *, right(substring(x, p + 1, e - p), 50) AS held, coalesce(old + size, p) AS q,
               CASE WHEN old IS NULL AND p >= fe THEN 'pop' WHEN lvl = 4 THEN 'cut' WHEN old IS NULL AND starts_with(w, sep) THEN 'skip' WHEN fe - p <= 512 THEN 'last'
                 WHEN len(parts) > 1 AND e > coalesce(old, p) THEN 'emit' ELSE 'push' END AS act
        FROM (SELECT *, p + length(w) - length(parts[-1]) - size AS e FROM (SELECT *, string_split(w, sep) AS parts FROM (
          SELECT *, substring(x, p + 1, least(512 + size, greatest(fe - p, 0))) AS w FROM (
            SELECT s.*, x, fr[lvl + 1] AS fe, [2, 1, 2, 1, 0][lvl + 1] AS size, [chr(10) || chr(10), chr(10), '. ', ' ', ''][lvl + 1] AS sep FROM step s JOIN txt USING (doc_id))))))
  WHERE NOT (act = 'pop' AND lvl = 0)),
chunks AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_index, chunk FROM (
    SELECT doc_id, k, regexp_replace(substring(x, a + 1, b - a), '^[{_SPACES}]+|[{_SPACES}]+$', '', 'g') AS chunk FROM step JOIN txt USING (doc_id) WHERE a IS NOT NULL
    UNION ALL SELECT doc_id, 0, x FROM txt WHERE length(x) <= 512) WHERE chunk <> '')"""
SQL["chunk_documents"] = f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, chunk_index, CAST(length(chunk) AS INTEGER) AS n_chars, sha256(chunk) AS chunk_sha256 FROM chunks"


def _hybrid(source: str | None) -> str:
    near, far = (f"WHERE source_type = '{source}'" if source else "", f"AND source_type = '{source}'" if source else "")
    words = rf"list_filter(regexp_split_to_array(lower(%s), '[{_SPACES}]+'), lambda w: w <> '')"
    return f"""
WITH RECURSIVE {_CHUNKS},
points AS (SELECT doc_id AS document_id, source AS source_type, chunk_index, chunk AS text, sha256(doc_id || '/' || chunk_index) AS point_id, 'doc-' || doc_id || '. ' || chunk AS search_text
           FROM chunks JOIN documents USING (doc_id) WHERE length({_strip('documents.text')}) >= 50),
hashed AS (
  SELECT key, h % 384 AS place, sum(CASE WHEN (h // 65536) % 2 = 1 THEN 1.0 ELSE -1.0 END) AS v
  FROM (SELECT key, ('0x' || left(md5(w), 8))::BIGINT AS h FROM (
    SELECT 'p' || point_id AS key, unnest({words % 'search_text'}) AS w FROM points UNION ALL SELECT 'q' || item_id, unnest({words % 'text'}) FROM benchmark)) GROUP BY ALL),
vectors AS (SELECT key, place, CAST(v / sqrt(sum(v * v) OVER (PARTITION BY key)) AS FLOAT)::DOUBLE AS v FROM hashed QUALIFY sum(v * v) OVER (PARTITION BY key) > 0),
shared AS (SELECT q.key[2:]::BIGINT AS query_id, p.key[2:] AS point_id, sum(p.v * q.v) AS score FROM vectors q JOIN vectors p ON p.place = q.place AND q.key[1] = 'q' AND p.key[1] = 'p' GROUP BY ALL),
dots AS (SELECT item_id AS query_id, p.point_id, round(coalesce(score, 0.0), 4) + 0.0 AS score FROM benchmark CROSS JOIN points p LEFT JOIN shared s ON s.query_id = item_id AND s.point_id = p.point_id),
near AS (SELECT query_id, point_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM dots JOIN points USING (point_id) {near} {'AND' if source else 'WHERE'} score >= 0 QUALIFY rank <= 48),
tok AS (SELECT point_id AS id, unnest({_tokens('search_text')}) AS term FROM points),
postings AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY id, term),
lengths AS (SELECT id, count(*) AS dl FROM tok GROUP BY id),
freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
total AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
terms AS (SELECT DISTINCT item_id AS query_id, unnest({_tokens('text')}) AS term FROM benchmark),
scored AS (SELECT query_id, p.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 4) AS bm25_score
           FROM terms JOIN postings p USING (term) JOIN freq USING (term) JOIN lengths l ON l.id = p.id, total GROUP BY query_id, p.id),
lexical AS (SELECT query_id, id AS point_id, 48 + row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, id DESC) AS rank FROM scored WHERE bm25_score > 0 QUALIFY rank <= 68),
hits AS (
  SELECT query_id, point_id, score, rank FROM near
  UNION ALL
  SELECT l.query_id, l.point_id, coalesce(d.score, 0.0), l.rank FROM lexical l JOIN points USING (point_id) LEFT JOIN dots d ON d.query_id = l.query_id AND d.point_id = l.point_id
  WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.query_id = l.query_id AND n.point_id = l.point_id) {far}),
capped AS (SELECT h.*, document_id, chunk_index, text FROM hits h JOIN points USING (point_id) QUALIFY row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) <= 3),
kept AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM capped QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 12),
starts AS (SELECT *, CASE WHEN document_id = lag(document_id) OVER o AND chunk_index = lag(chunk_index) OVER o + 1 THEN 0 ELSE 1 END AS s FROM kept WINDOW o AS (PARTITION BY query_id ORDER BY document_id::VARCHAR, chunk_index, rank)),
isl AS (SELECT *, sum(s) OVER (PARTITION BY query_id ORDER BY document_id::VARCHAR, chunk_index, rank ROWS UNBOUNDED PRECEDING) AS island FROM starts),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id, island ORDER BY chunk_index, text) AS k, count(*) OVER (PARTITION BY query_id, island) AS merged FROM isl),
fold AS (
  SELECT query_id, island, k, text FROM numbered WHERE k = 1
  UNION ALL
  SELECT n.query_id, n.island, n.k, f.text || CASE WHEN o.size IS NULL THEN chr(10) || n.text ELSE substring(n.text, o.size + 1) END
  FROM fold f JOIN numbered n ON n.query_id = f.query_id AND n.island = f.island AND n.k = f.k + 1,
       LATERAL (SELECT max(size) AS size FROM (SELECT unnest(range(21, least(length(f.text), length(n.text), 200) + 1)) AS size) WHERE right(f.text, size) = left(n.text, size)) o),
runs AS (SELECT query_id, island, any_value(document_id) AS document_id, max(chunk_index) AS chunk_index, max(score) AS score, max(merged) AS merged FROM numbered GROUP BY query_id, island)
SELECT r.query_id, CAST(row_number() OVER (PARTITION BY r.query_id ORDER BY r.score DESC, r.island) AS INTEGER) AS chunk_id, r.document_id, r.chunk_index, r.score, r.merged, sha256(f.text) AS text_sha256
FROM runs r JOIN fold f ON f.query_id = r.query_id AND f.island = r.island AND f.k = r.merged"""


SQL["hybrid_search"] = _hybrid(None)
SQL["hybrid_search_filtered"] = _hybrid("src1")


def _interaction(pairs: str) -> str:
    """The score of pairs (id, q, p), from qw and pw, the distinct words of their questions and passages."""
    return f"""
grams AS (SELECT w, ('0x' || left(md5(substring('^' || w || '$', i, 3)), 8))::BIGINT AS h FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM (SELECT w FROM qw UNION SELECT w FROM pw))),
wv AS (SELECT w, h % 256 AS place, CAST(sum(CASE WHEN (h // 65536) % 2 = 1 THEN 1 ELSE -1 END) AS DOUBLE) AS v FROM grams GROUP BY ALL),
wn AS (SELECT w, sum(v * v) AS n FROM wv GROUP BY w),
near_words AS (SELECT a.w AS a, b.w AS b, sum(a.v * b.v) / sqrt(any_value(x.n * y.n)) AS s FROM (SELECT * FROM wv WHERE w IN (SELECT w FROM qw)) a JOIN (SELECT * FROM wv WHERE w IN (SELECT w FROM pw)) b USING (place)
               JOIN wn x ON x.w = a.w JOIN wn y ON y.w = b.w GROUP BY a.w, b.w HAVING sum(a.v * b.v) > 0),
best_words AS (SELECT h.q, h.p, qw.w, coalesce(max(s), 0) AS s FROM {pairs} h JOIN qw ON qw.q = h.q JOIN pw ON pw.p = h.p LEFT JOIN near_words n ON n.a = qw.w AND n.b = pw.w GROUP BY ALL),
scores AS (SELECT q, p, round(sum(s), 4) AS rerank_score FROM best_words GROUP BY ALL)"""


_RANKED = f"""qw AS (SELECT item_id AS q, unnest(list_distinct({_tokens("text")})) AS w FROM benchmark),
pw AS (SELECT point_id AS p, unnest(list_distinct({_tokens("text")})) AS w FROM points WHERE point_id IN (SELECT point_id FROM hits)),
pairs AS (SELECT query_id AS q, point_id AS p FROM hits),{_interaction("pairs")},
ranked AS (SELECT query_id, point_id, score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(rerank_score, 0) DESC, rank) AS rank FROM hits LEFT JOIN scores ON q = query_id AND p = point_id),
"""
SQL["hybrid_search_reranked"] = _hybrid(None).replace("capped AS (", _RANKED + "capped AS (", 1).replace("FROM hits h JOIN points", "FROM ranked h JOIN points")
SQL["rerank_scores"] = f"""
WITH qw AS (SELECT conv_id AS q, unnest(list_distinct({_tokens("text")})) AS w FROM conversations WHERE turn = 0),
pw AS (SELECT conv_id || ':' || turn AS p, unnest(list_distinct({_tokens("text")})) AS w FROM conversations WHERE turn > 0),
pairs AS (SELECT t.conv_id AS q, t.conv_id || ':' || t.turn AS p, t.turn FROM conversations t JOIN conversations f ON f.conv_id = t.conv_id AND f.turn = 0 WHERE t.turn > 0),{_interaction("pairs")}
SELECT pairs.q AS conv_id, turn, rerank_score FROM pairs LEFT JOIN scores USING (q, p)"""
SQL["char_chunks"] = """
WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 462)) AS place FROM documents)
SELECT doc_id, CAST(place / 462 AS INTEGER) AS chunk_index, CAST(length(substring(text, place + 1, 512)) AS INTEGER) AS n_chars, sha256(substring(text, place + 1, 512)) AS chunk_sha256 FROM s WHERE text <> ''"""
SQL["contextualise"] = """
SELECT doc_id, sha256(concat_ws('. ', coalesce(CASE WHEN lang <> 'en' THEN lang END, source), text)) AS search_sha256 FROM documents"""
SQL["ingest_outcomes"] = f"""
WITH n AS (SELECT length({_strip("coalesce(text, '')")}) AS c FROM documents)
SELECT CASE WHEN c >= 50 THEN 'completed' ELSE 'failed' END AS status, count(*) AS n, CAST(sum(c) AS BIGINT) AS chars FROM n GROUP BY 1"""
SQL["upsert_points"] = """
SELECT conv_id AS document_id, turn AS chunk_index, CAST(length(text) AS INTEGER) AS n FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 0, quality FROM labels"""
SQL["chunk_preview"] = "SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k IN (2, 3)"

_REPORTS = r"""
rep AS (SELECT doc_id, (CASE WHEN lang = 'en' THEN 'FINDINGS' || chr(10) WHEN lang = 'de' THEN '**Findings**' || chr(10) ELSE '' END) || text || chr(10) || 'Left nodule of 8 mm, ' || source || ' possibly possible TODO' || chr(10)
        || (CASE WHEN lang <> 'es' THEN chr(10) || 'IMPRESSION' || chr(10) || 'Right nodule of 9 mm and 8 mm unchanged ' || lang ELSE '' END) AS text FROM documents),
cut AS (SELECT doc_id, text, regexp_extract(text, '(?im)^\W*\**\s*(?:impression|conclusion)s?\s*\**\W*$') AS head FROM rep),
sec AS (SELECT doc_id, text, CASE WHEN head = '' THEN text ELSE left(text, instr(text, head) - 1) END AS findings,
        CASE WHEN head = '' THEN '' ELSE substring(text, instr(text, head) + length(head)) END AS impression FROM cut)"""


def _bare(x: str) -> str:
    for pattern in (r"(?im)^\W*\**\s*findings\s*\**\W*$", r"(?im)^\W*\**\s*(?:impression|conclusion)s?\s*\**\W*$", r"(?i)\*?\s*draft for radiologist review[^\n]*", r"[\s\-*•·]"):
        x = f"regexp_replace({x}, '{pattern}', '', 'g')"
    return x


SQL["quality_sections"] = rf"""
WITH {_REPORTS},
c AS (SELECT doc_id, regexp_matches(text, '(?im)^\W*\**\s*findings\s*\**\W*$') AS f, regexp_matches(text, '(?im)^\W*\**\s*(?:impression|conclusion)s?\s*\**\W*$') AS i,
      length({_bare('findings')}) < 10 AS ef, length({_bare('impression')}) < 10 AS ei FROM sec)
SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT f THEN 'missing_findings' END, CASE WHEN f AND ef THEN 'empty_findings' END, CASE WHEN NOT i THEN 'missing_impression' END, CASE WHEN i AND ei THEN 'empty_impression' END], lambda x: x IS NOT NULL), ',') AS codes FROM c"""
SQL["quality_placeholders"] = rf"""
WITH {_REPORTS} SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)\b(?:TODO|TBD|FIXME|XXX+|LOREM IPSUM|INSERT\s+\w+|PATIENT\s*NAME|\[\s*\]|_{{3,}}|\.{{4,}})')) AS INTEGER) AS n FROM rep"""
SQL["quality_hedging"] = f"""
WITH {_REPORTS}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM rep),
h AS (SELECT doc_id, k, len(list_filter({_list(HEDGES)}, lambda x: contains(lower(line), x))) AS hits FROM l)
SELECT doc_id, CAST(count(*) FILTER (hits >= 2) AS INTEGER) AS n, CAST(min(k) FILTER (hits >= 2) AS INTEGER) AS line FROM h GROUP BY doc_id"""
_SIDES = r"""s AS (SELECT doc_id, regexp_matches(findings, '(?i)\bleft\b|\bl\.?[\s-]?sided\b') AS fl, regexp_matches(findings, '(?i)\bright\b|\br\.?[\s-]?sided\b') AS fr,
  regexp_matches(impression, '(?i)\bleft\b|\bl\.?[\s-]?sided\b') AS il, regexp_matches(impression, '(?i)\bright\b|\br\.?[\s-]?sided\b') AS ir FROM sec)"""
SQL["quality_laterality"] = f"WITH {_REPORTS}, {_SIDES} SELECT doc_id, CAST((il AND NOT fl AND fr)::INT + (ir AND NOT fr AND fl)::INT AS INTEGER) AS n FROM s"
_MEASURES = r"'(?i)\b\d+(?:\.\d+)?\s*(?:(?:mm|cm|percent)\b|%)'"
SQL["quality_measurements"] = f"""
WITH {_REPORTS}, m AS (SELECT doc_id, list_transform(regexp_extract_all(findings, {_MEASURES}), lambda x: replace(lower(x), ' ', '')) AS known, regexp_extract_all(impression, {_MEASURES}) AS own FROM sec),
n AS (SELECT doc_id, list_filter(own, lambda x: NOT list_contains(known, replace(lower(x), ' ', ''))) AS new FROM m)
SELECT doc_id, CAST(len(new) AS INTEGER) AS n, new[1] AS excerpt FROM n"""
SQL["quality_terms"] = f"""
WITH {_REPORTS}, w AS (SELECT doc_id, {_content('findings')} AS known, list_filter({_content('impression')}, lambda x: NOT list_contains({_list(COVERED)}, x)) AS own FROM sec),
n AS (SELECT doc_id, list_sort(list_filter(own, lambda x: NOT list_contains(known, x) AND len(list_filter(known, lambda k: starts_with(k, left(x, 5)) OR starts_with(x, left(k, 5)))) = 0)) AS novel FROM w)
SELECT doc_id, array_to_string(novel[1:6], ',') AS terms FROM n"""



def _unitless(x: str) -> str:
    """Numbers after a measuring word that letters follow which begin no unit; RE2 has no look-ahead."""
    seen = rf"regexp_extract_all({x} || chr(0), '(?i)\b(?:measur\w+|approximately|approx\.?|about|up to|size of)\s+\d+(?:\.\d+)?\s*(?:[a-z°%]{{1,10}}|[°%]|\n?\x00)')"
    return rf"list_filter({seen}, lambda m: NOT regexp_matches(m, '(?i)\d\s*(?:mm|cm|m$|millimet|centimet|%|percent|degrees?|°)'))"


def _vague(x: str) -> str:
    """Sizes that no number follows within 40 characters of their sentence: from the pieces between them."""
    word = r"(?i)\b(?:somewhat|fairly|rather|slightly)?\s*(?:enlarged|prominent|increased|decreased|small|large|big)\b"
    found, pieces = f"regexp_extract_all({x}, '{word}')", f"regexp_split_to_array({x}, '{word}')"
    after = f"array_to_string(list_concat(list_zip({pieces}[i + 1:i + 41], {found}[i + 1:i + 41]).list_transform(lambda z: z[1] || coalesce(z[2], ''))), '')"
    return rf"list_filter(range(1, len({found}) + 1), lambda i: NOT regexp_matches(left({after}, 60), '^[^.]{{0,40}}\b\d'))"


SQL["quality_units"] = rf"""
WITH b AS (SELECT doc_id, text || chr(10) || 'Nodule measuring 8 and approximately 9 mm, somewhat enlarged.' AS text FROM documents),
sec AS (SELECT doc_id, text, CASE WHEN head = '' THEN text ELSE left(text, instr(text, head) - 1) END AS findings
        FROM (SELECT *, regexp_extract(text, '(?im)^\W*\**\s*(?:impression|conclusion)s?\s*\**\W*$') AS head FROM b))
SELECT doc_id, CAST(len({_unitless("text")}) AS INTEGER) AS unitless, CAST(len({_vague("findings")}) AS INTEGER) AS vague FROM sec"""


def _with(name: str) -> str:
    """The query of that name as a common table expression."""
    return f"{name} AS ({SQL[name].strip()})"


SQL["quality_summary"] = rf"""
WITH {_REPORTS}, {", ".join(map(_with, ("quality_sections", "quality_placeholders", "quality_hedging", "quality_laterality", "quality_measurements", "quality_terms")))},
u AS (SELECT doc_id, len({_unitless("text")}) AS n, length({_strip("text")}) = 0 AS blank FROM rep),
c AS (SELECT doc_id, blank, CASE WHEN s.codes = '' THEN 0 ELSE len(string_split(s.codes, ',')) END + p.n + u.n + l.n + m.n AS e, h.n + CASE WHEN t.terms = '' THEN 0 ELSE 1 END AS w
      FROM quality_sections s JOIN quality_placeholders p USING (doc_id) JOIN quality_hedging h USING (doc_id) JOIN quality_laterality l USING (doc_id)
      JOIN quality_measurements m USING (doc_id) JOIN quality_terms t USING (doc_id) JOIN u USING (doc_id))
SELECT doc_id, CAST(CASE WHEN blank THEN 1 ELSE e END AS INTEGER) AS errors, CAST(CASE WHEN blank THEN 0 ELSE w END AS INTEGER) AS warnings, blank = false AND e = 0 AND w = 0 AS is_clean FROM c"""

_STUDIES = """
st AS (SELECT a.conv_id, a.turn, 'Nodule of 1.2 cm in the lung. ' || a.text AS prior, 'Nodule of 15 mm in the lung. ' || b.text AS current FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""
_VALUE = r"(\d+(?:\.\d+)?)\s*((?:mm|cm|millimet(?:re|er)s?|centimet(?:re|er)s?|percent)\b|%)"
SQL["measurements"] = rf"""
WITH {_REPORTS}, v AS (SELECT doc_id, regexp_extract_all(text, '(?i){_VALUE}', 1) AS numbers, regexp_extract_all(text, '(?i){_VALUE}', 2) AS units FROM rep),
e AS (SELECT doc_id, unnest(range(0, len(numbers))) AS pos, numbers, units FROM v),
u AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(numbers[pos + 1] AS DOUBLE) AS value, CASE WHEN lower(units[pos + 1]) = 'percent' THEN '%' ELSE lower(units[pos + 1]) END AS unit FROM e)
SELECT doc_id, pos, value, unit, value * CASE WHEN unit IN ('mm', 'millimetre', 'millimeter') THEN 1.0 WHEN unit IN ('cm', 'centimetre', 'centimeter') THEN 10.0 END::DOUBLE AS mm FROM u"""
SQL["jaccard_mismatch"] = f"""
WITH {_STUDIES}, w AS (SELECT conv_id, turn, {_context('prior')} AS a, {_context('current')} AS b FROM st)
SELECT conv_id, turn, round({_overlap('a', 'b')}, 6) AS overlap, len(a) >= 5 AND len(b) >= 5 AND ({_overlap('a', 'b')}) < 0.08 AS other_study FROM w"""
SQL["agreement"] = f"""
WITH {_STUDIES}, w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(prior), '[a-z0-9%]+')) AS a, list_distinct(regexp_extract_all(lower(current), '[a-z0-9%]+')) AS b FROM st)
SELECT conv_id, turn, CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, b)) / len(a), 3) END AS agreement FROM w"""
SQL["study_mismatch"] = f"""
WITH w AS (SELECT conv_id, turn, {_context("'Lumbar vertebra alignment preserved, sacral disc height maintained, thecal conus unremarkable.'")} AS a, {_context('text')} AS b FROM conversations)
SELECT conv_id, turn, CASE WHEN len(a) >= 5 AND len(b) >= 5 AND ({_overlap('a', 'b')}) < 0.08 THEN 'The reports have ' || CAST(round_even(({_overlap('a', 'b')}) * 100, 0) AS INTEGER)
  || '% of their words in common: they may be of different studies or regions. Make sure that the earlier report is the right one.' ELSE '' END AS warning FROM w"""

# Measurements with their places and sentences, each earlier one paired in turn with the most alike later one.
_PLACES = rf"""
me AS (
  SELECT conv_id, turn, 'prior' AS side, prior || chr(10) || 'Liver cyst 2.' || conv_id % 7 || ' cm; kidney stone 4 mm. Height loss 50 percent' AS x FROM st
  UNION ALL
  SELECT conv_id, turn, 'current', current || chr(10) || 'Kidney stone ' || turn || ' mm. Liver cyst 2' || conv_id % 7 || ' mm; height loss ' || turn || '%' FROM st),
raw AS (SELECT *, regexp_extract_all(x, '(?i){_VALUE}', 0) AS raws, regexp_extract_all(x, '(?i){_VALUE}', 1) AS numbers, regexp_extract_all(x, '(?i){_VALUE}', 2) AS units FROM me),
place AS (
  SELECT conv_id, turn, side, 0 AS i, 0 AS start, 0 AS stop FROM raw
  UNION ALL
  SELECT p.conv_id, p.turn, p.side, p.i + 1, p.stop + instr(substring(x, p.stop + 1), raws[p.i + 1]) - 1, p.stop + instr(substring(x, p.stop + 1), raws[p.i + 1]) - 1 + length(raws[p.i + 1])
  FROM place p JOIN raw r ON r.conv_id = p.conv_id AND r.turn = p.turn AND r.side = p.side WHERE p.i < len(raws)),
ends AS (
  SELECT conv_id, turn, side, k, x[k + 1] = chr(10) OR NOT regexp_matches(x[k + 2], '^\d') AS whole
  FROM (SELECT *, unnest(range(0, length(x))) AS k FROM me) WHERE x[k + 1] = chr(10) OR (x[k + 1] IN ('.', ';') AND NOT regexp_matches(CASE WHEN k > 0 THEN x[k] ELSE '' END, '\d'))),
m AS (
  SELECT p.conv_id, p.turn, p.side, p.i, raws[p.i] AS raw, CAST(numbers[p.i] AS DOUBLE) AS v, CASE lower(units[p.i]) WHEN 'percent' THEN '%' ELSE lower(units[p.i]) END AS unit,
         {_strip('substring(x, coalesce(b.k, 0) + 1, coalesce(a.k, length(x)) - coalesce(b.k, 0))')} AS sentence
  FROM place p JOIN raw r ON r.conv_id = p.conv_id AND r.turn = p.turn AND r.side = p.side,
       LATERAL (SELECT max(k) + 1 AS k FROM ends e WHERE e.conv_id = p.conv_id AND e.turn = p.turn AND e.side = p.side AND e.k < p.start AND (e.whole OR e.k + 1 = p.start)) b,
       LATERAL (SELECT min(k) AS k FROM ends e WHERE e.conv_id = p.conv_id AND e.turn = p.turn AND e.side = p.side AND e.k >= p.stop AND e.whole) a
  WHERE p.i > 0),
c AS (SELECT *, {_context('sentence')} AS w, CASE unit WHEN 'mm' THEN 1.0 WHEN 'cm' THEN 10.0 END::DOUBLE AS factor FROM m),
alike AS (SELECT p.conv_id, p.turn, p.i, q.i AS j, {_overlap('p.w', 'q.w')} AS o FROM c p JOIN c q ON q.conv_id = p.conv_id AND q.turn = p.turn AND p.side = 'prior' AND q.side = 'current'),
chosen AS (
  SELECT conv_id, turn, 0 AS i, NULL::BIGINT AS j, []::BIGINT[] AS used FROM st
  UNION ALL
  SELECT conv_id, turn, i, CASE WHEN o >= 0.3 THEN j END, CASE WHEN o >= 0.3 THEN list_append(used, j) ELSE used END
  FROM (SELECT s.conv_id, s.turn, s.i + 1 AS i, s.used, arg_max(k.j, (o, -k.j)) AS j, max(o) AS o
        FROM chosen s JOIN c p ON p.conv_id = s.conv_id AND p.turn = s.turn AND p.side = 'prior' AND p.i = s.i + 1 LEFT JOIN alike k ON k.conv_id = s.conv_id AND k.turn = s.turn AND k.i = s.i + 1 AND NOT list_contains(s.used, k.j)
        GROUP BY ALL)),
pr AS (
  SELECT h.conv_id, h.turn, h.i, h.j, p.raw AS p_raw, q.raw AS q_raw, left(p.sentence, 110) AS p_said, left(q.sentence, 110) AS q_said, p.unit AS p_unit, q.unit AS q_unit, '%' IN (p.unit, q.unit) AS shares,
         CASE WHEN '%' NOT IN (p.unit, q.unit) THEN round(q.v * q.factor - p.v * p.factor, 2) END AS delta
  FROM chosen h JOIN c p ON p.conv_id = h.conv_id AND p.turn = h.turn AND p.side = 'prior' AND p.i = h.i JOIN c q ON q.conv_id = h.conv_id AND q.turn = h.turn AND q.side = 'current' AND q.i = h.j),
told AS (
  SELECT conv_id, turn, count(*) AS n, arg_min(coalesce(delta, -1.0), i) AS delta, list(j) AS used, list(i) AS paired,
         string_agg('  - earlier ' || p_raw || ', now ' || q_raw || CASE WHEN p_raw = q_raw OR delta = 0 THEN ': the same value'
           WHEN delta IS NOT NULL THEN ': ' || regexp_replace(printf('%.2f', abs(delta)), '\.?0+$', '') || CASE WHEN delta > 0 THEN ' mm more as printed' ELSE ' mm less as printed' END
           WHEN shares AND p_unit = q_unit THEN '' WHEN shares THEN '. A share and a length have no difference.' ELSE '. One of the units has no conversion.' END
           || chr(10) || '      earlier: ' || p_said || chr(10) || '      now: ' || q_said, chr(10) ORDER BY i) AS lines,
         string_agg(CASE WHEN delta IS NOT NULL AND p_unit <> q_unit THEN '  ! ' || p_raw || ' and ' || q_raw || ' have different units; their difference is in millimetres.' END, chr(10) ORDER BY i) AS warned,
         count(CASE WHEN delta IS NOT NULL AND p_unit <> q_unit THEN 1 END) AS warnings
  FROM pr GROUP BY conv_id, turn),
alone AS (
  SELECT c.conv_id, c.turn, side, string_agg(raw, ',' ORDER BY i) AS raws,
         string_agg('  - ' || raw || ' in the ' || CASE side WHEN 'prior' THEN 'earlier' ELSE 'current' END || ' report alone: ' || left(sentence, 110), chr(10) ORDER BY i) AS lines
  FROM c LEFT JOIN told t ON t.conv_id = c.conv_id AND t.turn = c.turn WHERE NOT coalesce(list_contains(CASE side WHEN 'prior' THEN paired ELSE used END, i), false) GROUP BY c.conv_id, c.turn, side)"""
_WARNING = f"""
warn AS (
  SELECT p.conv_id, p.turn, CASE WHEN len(a) >= 5 AND len(b) >= 5 AND ({_overlap('a', 'b')}) < 0.08 THEN 'The reports have ' || CAST(round_even(({_overlap('a', 'b')}) * 100, 0) AS INTEGER)
         || '% of their words in common: they may be of different studies or regions. Make sure that the earlier report is the right one.' END AS mismatch
  FROM (SELECT conv_id, turn, {_context('x')} AS a FROM me WHERE side = 'prior') p JOIN (SELECT conv_id, turn, {_context('x')} AS b FROM me WHERE side = 'current') q USING (conv_id, turn))"""
SQL["measurement_pairs"] = f"""
WITH RECURSIVE {_STUDIES}, {_PLACES}, {_WARNING}
SELECT conv_id, turn, CAST(coalesce(n, 0) AS INTEGER) AS pairs, coalesce(delta, -1.0) AS delta_mm, coalesce(b.raws, '') AS prior_only, coalesce(a.raws, '') AS current_only,
       CAST(coalesce(warnings, 0) + (mismatch IS NOT NULL)::INT AS INTEGER) AS warnings,
       sha256(concat_ws(chr(10) || chr(10), 'SAY FIRST THAT THE STUDIES MAY NOT BELONG TOGETHER:' || chr(10) || '  ' || mismatch,
         concat_ws(chr(10), 'MEASUREMENTS AS PRINTED, ALREADY COMPARED:', t.lines, b.lines, a.lines, nullif(concat_ws(chr(10), warned, '  ! ' || mismatch), ''), '  Whether a difference is a change or a matter of measuring isn''t settled.'))) AS told_sha256
FROM st LEFT JOIN told t USING (conv_id, turn) LEFT JOIN alone b ON b.conv_id = st.conv_id AND b.turn = st.turn AND b.side = 'prior'
  LEFT JOIN alone a ON a.conv_id = st.conv_id AND a.turn = st.turn AND a.side = 'current' LEFT JOIN warn w ON w.conv_id = st.conv_id AND w.turn = st.turn"""

_EVAL = f"""{_HITS},
questions AS (SELECT item_id AS query_id, lower(text) AS keyword, CASE WHEN length(text) > 200 THEN 'long' ELSE 'short' END AS category, length(text) > 40 AS should_answer,
              length(text) AS latency_ms, CASE WHEN length(text) > 300 THEN 'too long' END AS error FROM benchmark),
found AS (SELECT r.query_id, rank, text, source, doc_id, bm25_score FROM ranked r JOIN documents d ON d.doc_id = r.id WHERE rank <= 12),
run AS (SELECT q.query_id, category, should_answer, latency_ms, error,
          min(rank) FILTER (contains(lower(text), keyword)) AS keyword_rank,
          min(rank) FILTER (contains(lower(source), 'src0') OR contains(lower(source), 'src3')) AS source_rank,
          coalesce(max(bm25_score) FILTER (rank = 1), 0.0) AS top_score, count(DISTINCT doc_id) AS distinct_documents, count(rank) AS n_results
        FROM questions q LEFT JOIN found f ON f.query_id = q.query_id GROUP BY ALL),
ev AS (SELECT *, coalesce(keyword_rank <= 5, false) AS keyword_hit_5, coalesce(keyword_rank <= 12, false) AS keyword_hit_12, coalesce(source_rank <= 5, false) AS source_hit_5,
         coalesce(source_rank <= 12, false) AS source_hit_12, coalesce(1 / keyword_rank, 1 / source_rank, 0.0) AS mrr FROM run)"""
SQL["eval_ranks"] = f"""
WITH {_EVAL} SELECT query_id, coalesce(keyword_rank, 0) AS keyword_rank, coalesce(source_rank, 0) AS source_rank, keyword_hit_5, keyword_hit_12, source_hit_5, source_hit_12, round(mrr, 6) AS mrr, top_score, distinct_documents, n_results FROM ev"""


def _pct(flag: str) -> str:
    return f"coalesce(round(100 * count(*) FILTER (should_answer AND {flag}) / nullif(count(*) FILTER (should_answer), 0), 1), 0.0)"


SQL["eval_summary"] = f"""
WITH {_EVAL} SELECT count(*) AS n_questions, count(*) FILTER (should_answer) AS n_answerable, {_pct('source_hit_5')} AS source_recall_5, {_pct('source_hit_12')} AS source_recall_12,
  {_pct('keyword_hit_5')} AS keyword_recall_5, {_pct('keyword_hit_12')} AS keyword_recall_12, coalesce(round(avg(mrr) FILTER (should_answer), 3), 0.0) AS mrr,
  coalesce(round(avg(top_score) FILTER (should_answer), 3), 0.0) AS mean_top_score, coalesce(round(avg(distinct_documents) FILTER (should_answer), 1), 0.0) AS mean_distinct_docs,
  coalesce(round(median(latency_ms)), 0.0) AS median_latency_ms, count(error) AS errors FROM ev"""
SQL["eval_by_category"] = f"WITH {_EVAL} SELECT category, count(*) AS n, round(100 * count(*) FILTER (keyword_hit_12) / count(*), 1) AS keyword_recall_12 FROM ev WHERE should_answer GROUP BY category"
SQL["eval_errors"] = f"WITH {_EVAL} SELECT error, count(*) AS n, array_to_string(list_sort(list(query_id))[1:3], ',') AS examples FROM ev WHERE error IS NOT NULL GROUP BY error"
SQL["eval_change"] = """
WITH s AS (SELECT l_linestatus, round(avg(l_quantity), 6) AS q, count(*) AS n FROM lineitem GROUP BY 1),
m AS (SELECT 'mean_quantity' AS metric, a.q AS before, b.q AS now FROM s a, s b WHERE a.l_linestatus = 'O' AND b.l_linestatus = 'F'
      UNION ALL SELECT 'latency_rows', a.n::DOUBLE, b.n::DOUBLE FROM s a, s b WHERE a.l_linestatus = 'O' AND b.l_linestatus = 'F')
SELECT metric, before, now, round(now - before, 3) AS delta, CASE WHEN contains(metric, 'latency') THEN round(now - before, 3) < 0 ELSE round(now - before, 3) > 0 END AS better FROM m WHERE round(now - before, 3) <> 0"""
SQL["keyword_status"] = """
WITH p AS (SELECT item_id AS query_id, text AS phrase FROM benchmark)
SELECT query_id, phrase, CASE WHEN EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = p.query_id AND contains(lower(d.text), lower(phrase))) THEN 'retrieved'
  WHEN EXISTS (SELECT 1 FROM documents d WHERE contains(lower(d.text), lower(phrase))) THEN 'in corpus but missed' ELSE 'not in corpus' END AS status FROM p"""

_LIMIT = """
r AS (SELECT event_type || ':' || user_id AS key, event_id, epoch_us(ts) / 1e6 AS ts, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS k FROM events),
fold AS (
  SELECT key, event_id, ts, k, true AS admitted, [ts] AS held, NULL::DOUBLE AS retry FROM r WHERE k = 1
  UNION ALL
  SELECT r.key, r.event_id, r.ts, r.k, len(e.live) < 2, CASE WHEN len(e.live) < 2 THEN list_append(e.live, r.ts) ELSE e.live END, CASE WHEN len(e.live) >= 2 THEN e.live[1] + 86400.0 - r.ts END
  FROM fold f JOIN r ON r.key = f.key AND r.k = f.k + 1, LATERAL (SELECT list_filter(f.held, lambda t: t > r.ts - 86400.0) AS live) e
)"""
SQL["rate_limit"] = f"WITH RECURSIVE {_LIMIT} SELECT event_id, admitted, CASE WHEN retry IS NULL THEN 1 ELSE greatest(1, CAST(floor(retry + 0.999) AS INTEGER)) END AS retry_seconds FROM fold"
SQL["rate_limit_counts"] = f"WITH RECURSIVE {_LIMIT} SELECT admitted, count(*) AS n FROM fold GROUP BY admitted"
# One step for each event: first what silence before it did, then the event itself.
SQL["answer_failover"] = """
WITH RECURSIVE e AS (
  SELECT user_id || ':' || (epoch_us(ts) // 432000000000) AS key, event_id, epoch_us(ts) AS "at", CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'end' ELSE 'token' END AS kind, event_id % 3 AS actor, props,
         row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 432000000000 ORDER BY ts, event_id) AS k FROM events),
f AS (
  SELECT key, 0::BIGINT AS k, 0::BIGINT AS turn, 0::BIGINT AS tokens, "at" AS since, NULL::VARCHAR AS error, NULL::VARCHAR AS done, NULL::BIGINT AS event_id, NULL::BIGINT AS ended, NULL::VARCHAR AS said FROM e WHERE k = 1
  UNION ALL
  SELECT key, k, CASE WHEN done IS NULL AND hit AND kind = 'error' AND tokens = 0 THEN turn + 1 ELSE turn END, CASE WHEN done IS NULL AND hit AND kind = 'token' THEN tokens + 1 ELSE tokens END,
         CASE WHEN done IS NULL AND hit THEN "at" ELSE since END, CASE WHEN done IS NULL AND hit AND kind = 'error' THEN props ELSE error END,
         CASE WHEN done IS NOT NULL OR NOT hit THEN done WHEN kind = 'end' THEN 'completed' WHEN kind = 'error' AND tokens > 0 THEN 'broken' WHEN kind = 'error' AND turn = 2 THEN 'failed' END,
         CASE WHEN done IS NULL AND hit THEN id ELSE event_id END, CASE WHEN done IS NULL AND hit THEN "at" ELSE ended END, CASE WHEN done IS NULL AND hit AND kind = 'token' THEN props END
  FROM (SELECT key, k, id, "at", kind, props, tokens, event_id,
               CASE WHEN n = 0 OR tokens > 0 THEN turn ELSE least(turn + n, 3) END AS turn, CASE WHEN n = 0 THEN since ELSE since + n * 86400000000 END AS since, CASE WHEN n = 0 THEN error ELSE 'no answer in time' END AS error,
               CASE WHEN n = 0 THEN done WHEN tokens > 0 THEN 'broken' WHEN turn + n >= 3 THEN 'failed' END AS done,
               CASE WHEN n = 0 THEN ended WHEN tokens > 0 THEN since + 86400000000 WHEN turn + n >= 3 THEN since + (3 - turn) * 86400000000 END AS ended,
               actor = CASE WHEN n = 0 OR tokens > 0 THEN turn ELSE least(turn + n, 3) END AS hit
        FROM (SELECT f.*EXCLUDE (k, event_id, said), e.k, e.event_id AS id, e."at", e.kind, e.actor, e.props, CASE WHEN f.done IS NULL THEN f.event_id END AS event_id,
                     CASE WHEN f.done IS NOT NULL OR e."at" <= f.since THEN 0 ELSE (e."at" - f.since - 1) // 86400000000 END AS n FROM f JOIN e ON e.key = f.key AND e.k = f.k + 1))),
closed AS (
  SELECT key, k, turn, tokens, error, ended, done FROM f WHERE done IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY k) = 1),
open AS (SELECT key, turn, tokens, since FROM f WHERE key NOT IN (SELECT key FROM closed) QUALIFY row_number() OVER (PARTITION BY key ORDER BY k DESC) = 1)
SELECT key, 'token' AS event, event_id, 'p' || turn AS actor, tokens AS n, ended AS "at", said AS data FROM f WHERE said IS NOT NULL
UNION ALL
SELECT c.key, done, e.event_id, CASE WHEN done <> 'failed' THEN 'p' || turn END, tokens, ended, CASE WHEN done <> 'completed' THEN error END FROM closed c LEFT JOIN e ON e.key = c.key AND e.k = c.k AND e."at" = ended
UNION ALL
SELECT key, CASE WHEN tokens > 0 THEN 'broken' ELSE 'failed' END, NULL, CASE WHEN tokens > 0 THEN 'p' || turn END, tokens, since + 86400000000 * CASE WHEN tokens > 0 THEN 1 ELSE 3 - turn END, 'no answer in time' FROM open"""
SQL["job_outcomes"] = """
WITH RECURSIVE e AS (
  SELECT user_id || ':' || (epoch_us(ts) // 864000000000) AS key, event_id, epoch_us(ts) AS "at", CASE event_type WHEN 'view' THEN 'beat' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'claim' END AS kind,
         'w' || event_id % 2 AS actor, props, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 864000000000 ORDER BY ts, event_id) AS k FROM events
  UNION ALL
  -- silence after the last event
  SELECT user_id || ':' || (epoch_us(ts) // 864000000000), NULL, 9000000000000000000, 'silence', NULL, NULL, count(*) + 1 FROM events GROUP BY 1),
f AS (
  SELECT key, 0::BIGINT AS k, 0::BIGINT AS attempt, NULL::VARCHAR AS holder, NULL::BIGINT AS due, false AS done, []::STRUCT(event VARCHAR, event_id BIGINT, actor VARCHAR, n BIGINT, "at" BIGINT, data VARCHAR)[] AS told FROM e WHERE k = 1
  UNION ALL
  SELECT key, k, CASE WHEN taken THEN attempt + 1 ELSE attempt END, CASE WHEN taken THEN actor WHEN own AND kind IN ('completed', 'failed') THEN NULL ELSE held END,
         CASE WHEN taken OR (own AND kind = 'beat') THEN "at" + 43200000000 ELSE due END, over OR (own AND kind IN ('completed', 'failed')),
         CASE WHEN expired THEN [{'event': 'expired', 'event_id': NULL, 'actor': holder, 'n': attempt, 'at': due, 'data': NULL}] ELSE [] END
         || CASE WHEN expired AND over THEN [{'event': 'failed', 'event_id': NULL, 'actor': NULL, 'n': attempt, 'at': due, 'data': 'no worker finished in time'}] ELSE [] END
         || CASE WHEN taken THEN [{'event': 'claimed', 'event_id': event_id, 'actor': actor, 'n': attempt + 1, 'at': "at", 'data': NULL}] ELSE [] END
         || CASE WHEN own AND kind IN ('completed', 'failed') THEN [{'event': kind, 'event_id': event_id, 'actor': actor, 'n': attempt, 'at': "at", 'data': props}] ELSE [] END
  FROM (SELECT *, NOT over AND held IS NULL AND kind = 'claim' AS taken, coalesce(NOT over AND held = actor, false) AS own
        FROM (SELECT *, CASE WHEN expired THEN NULL ELSE holder END AS held, done OR (expired AND attempt >= 3) AS over
              FROM (SELECT f.key, e.k, f.attempt, f.holder, f.due, f.done, e.event_id, e."at", e.kind, e.actor, e.props, NOT f.done AND f.holder IS NOT NULL AND f.due < e."at" AS expired FROM f JOIN e ON e.key = f.key AND e.k = f.k + 1))))
SELECT key, t.event, t.event_id, t.actor, t.n, t."at", t.data FROM (SELECT key, unnest(told) AS t FROM f)"""
SQL["tumbling_windows"] = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
SQL["sliding_windows"] = """
WITH s AS (SELECT date_trunc('hour', ts) - to_hours(unnest(range(0, 24))) AS start, event_type FROM events) SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM s GROUP BY ALL"""
SQL["session_windows"] = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM n GROUP BY user_id, k"""

SQL["page_text"] = r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, trim(regexp_replace(t, '[ \t\n\r]+', ' ', 'g')) AS t FROM a)
SELECT page_id, CAST(length(t) AS INTEGER) AS n_chars, sha256(t) AS text_sha256 FROM b"""
SQL["jats_articles"] = rf"""
WITH b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g') || '  end.', '[{_SPACES}]+', ' ', 'g')) AS body FROM documents),
n AS (SELECT doc_id, length(body) + 7 AS n FROM b)
SELECT doc_id, CASE WHEN n >= 600 THEN 'open-access' END AS licence, CAST(CASE WHEN n > 120000 THEN 120013 WHEN n >= 600 THEN n END AS INTEGER) AS n_chars, CASE WHEN n >= 600 THEN 1 END AS figures FROM n"""
SQL["licence"] = """
SELECT page_id, CASE WHEN split_part(url, '/', 4) <> '' THEN 'CC-' || upper(split_part(url, '/', 4)) || ' 4.0' ELSE 'https://creativecommons.org/licenses//4.0/' END AS licence,
       regexp_matches(lower(url), 'logo|icon|orcid|cover|banner|headshot') AS decorative FROM pages"""
SQL["article_numbers"] = """
SELECT page_id, CASE WHEN page_id % 3 = 0 OR page_id % 2 = 0 THEN 'PMC' || page_id ELSE '' END AS number, 'https://host/articles/pmc' || page_id || '/bin/gr1' AS figure FROM pages"""
SQL["sse_events"] = """
SELECT conv_id, turn, 'event: token' || chr(10) || 'data: {"n": ' || length(text) || '}' || chr(10) || chr(10) AS frame, '{"n": ' || length(text) || '}' AS data FROM conversations"""
SQL["citation_fix"] = "SELECT item_id, translate('【1】［2］ ' || text, '【】［］', '[][]') AS fixed FROM benchmark"
SQL["citation_valid"] = "SELECT item_id, item_id BETWEEN 1 AND 12 AND item_id % 5 <> 0 AND item_id % 7 <> 0 AS valid FROM benchmark"
_QUOTED = {k: v.replace("'", "''") for k, v in (ROLES | {f"ground {k}": v for k, v in GROUNDING.items()}).items()}
_NO_SOURCE = "chr(10) || chr(10) || chr(10) || 'The knowledge base holds no source for this question.'"
_SOURCE = "chr(10) || chr(10) || 'SOURCES TO ANSWER FROM:' || chr(10) || chr(10) || '[1] Title (general, score 0.50)' || chr(10) || text || chr(10)"


def _frame(title: str) -> str:
    rule = "=" * 60
    return f"chr(10) || chr(10) || '{rule}' || chr(10) || '{title}' || chr(10) || '{rule}' || chr(10) || text || chr(10) || '{rule}' || chr(10) || '{title} ENDS' || chr(10)"


def _message(mode: str, role: str, ground: str, rest: str) -> str:
    return f"SELECT item_id, '{mode}' AS mode, sha256('{_QUOTED[role]}' || chr(10) || chr(10) || '{_QUOTED['ground ' + ground]}' || {rest}) AS message_sha256 FROM benchmark"


SQL["prompts"] = " UNION ALL ".join(
    [
        _message("qa", "qa:resident", "qa", _SOURCE),
        _message("report", "report", "report", _NO_SOURCE),
        _message("report_analysis", "report_analysis", "report_analysis", f"{_frame('ATTACHED TEXT')} || chr(10) || 'The text was read by a machine and may hold errors:' || chr(10) || '  - blurred' || chr(10) || {_NO_SOURCE}"),
        _message("comparison", "comparison", "comparison", f"{_frame('EARLIER REPORT')} || chr(10) || 'FACTS' || chr(10) || {_SOURCE}"),
    ]
)
SQL["answer_stream"] = """
WITH t AS (SELECT item_id, string_split('[1] ' || translate(text, '【】［］', '[][]'), ' ') AS w FROM benchmark),
e AS (SELECT item_id, 0 AS pos, 'sources' AS event, '[{"chunk_id":1}]' AS data FROM t UNION ALL SELECT item_id, len(w) + 1, 'done', '{}' FROM t
      UNION ALL SELECT item_id, i, 'token', '{"text":' || to_json(w[i]) || '}' FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM t))
SELECT item_id, CAST(pos AS INTEGER) AS pos, event, data FROM e"""
SQL["deleted_documents"] = """
WITH g AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
r AS (SELECT 'document' AS kind, doc_id FROM documents WHERE doc_id NOT IN (FROM g) UNION ALL SELECT 'label', doc_id FROM labels WHERE doc_id NOT IN (FROM g)
      UNION ALL SELECT 'turn', CASE WHEN conv_id NOT IN (FROM g) THEN conv_id END FROM conversations)
SELECT kind, count(*) AS n, count(doc_id) AS linked, CAST(sum(doc_id) AS BIGINT) AS total FROM r GROUP BY kind"""
SQL["inserted_documents"] = """
WITH r AS (SELECT page_id, page_id % 2 = 0 AS taken, length(html) AS size FROM pages),
t AS (SELECT page_id, CASE WHEN NOT taken THEN 'files of type .exe aren''t taken' WHEN size = 0 THEN 'the file is empty' WHEN size > 2000 THEN 'the file is larger than 2000 bytes' END AS reason FROM r)
SELECT page_id, CASE WHEN reason IS NULL THEN 'pending' ELSE 'rejected' END AS status, reason FROM t"""
SQL["status_changes"] = """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus <> 'O' THEN 'failed' WHEN o_orderpriority = '1-URGENT' THEN 'completed' WHEN o_orderpriority = '2-HIGH' THEN 'failed' ELSE 'processing' END AS status FROM orders"""
SQL["updated_vectors"] = "SELECT vec_id, label, round(CASE WHEN label = 3 THEN -embedding[1] ELSE embedding[1] END::DOUBLE, 6) AS first FROM embeddings"
SQL["middle_slices"] = "SELECT vec_id, 16 AS n, embedding[16 * CAST(floor((vec_id % 4 + 1) / 2) AS BIGINT) + 1] AS first FROM embeddings"
SQL["confidences"] = """
WITH r AS (SELECT vec_id, list_filter(list_transform(embedding, lambda x: round(x::DOUBLE * 100, 0)), lambda x: x >= 0) AS k FROM embeddings)
SELECT vec_id, CASE WHEN len(k) > 0 THEN round(list_sum(k) / len(k), 1) ELSE 0.0 END AS confidence FROM r"""
SQL["eval_bands"] = f"""
WITH {_EVAL}, c AS (SELECT category, count(*) AS n, round(100 * count(*) FILTER (keyword_hit_12) / count(*), 1) AS keyword_recall_12 FROM ev WHERE should_answer GROUP BY category)
SELECT *, CASE WHEN keyword_recall_12 >= 80 THEN 'good' WHEN keyword_recall_12 >= 50 THEN 'fair' ELSE 'poor' END AS band FROM c"""
SQL["contacts"] = """
SELECT c_custkey, lower(c_name) || '@host.org' AS email, coalesce(CASE WHEN c_custkey % 3 = 0 THEN '10.0.0.' || c_nationkey END, CASE WHEN c_custkey % 2 = 0 THEN '1.2.3.4' END, 'unknown') AS client,
       array_to_string(list_transform(string_split(lower(c_mktsegment) || ' report of ct.v2', ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM customer"""
SQL["pixel_windowing"] = """
WITH r AS (SELECT vec_id, list_transform(embedding, lambda p: CAST(floor(least(greatest((p::DOUBLE * 1000.0 - 50.0 + 160.0) / 400.0, 0.0), 1.0) * 255) AS INTEGER)) AS levels FROM embeddings)
SELECT vec_id, CAST(list_sum(levels) AS INTEGER) AS sum, list_max(levels) AS most, 255 - levels[1] AS first_shown FROM r"""
SQL["study_years"] = "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders"


# ---- sources of bytes, and the index that follows ----

SQL["dicom_images"] = """
WITH stored AS (
  SELECT vec_id, list_transform(embedding, lambda x: (floor(x::DOUBLE * 1000) + 10 * ((vec_id % 3 + 1) // 2)) * 2 - 50) AS real FROM embeddings WHERE len(embedding) = 64
), window_of AS (
  SELECT *, CASE WHEN vec_id % 2 = 0 THEN -100.0 ELSE list_min(real) END AS low, CASE WHEN vec_id % 2 = 0 THEN 300.0 ELSE list_max(real) END AS high FROM stored
), cut AS (
  SELECT *, CASE WHEN high > low THEN high ELSE low + 1 END AS top FROM window_of
), levels AS (
  SELECT vec_id, unnest(range(64)) AS i, floor(least(greatest((unnest(real) - low) / (top - low), 0.0), 1.0) * 255)::INT AS v FROM cut
), shown AS (
  SELECT vec_id, string_agg(format('{:02X}', CASE WHEN vec_id % 5 = 0 THEN 255 - v ELSE v END), '' ORDER BY i) AS levels FROM levels GROUP BY vec_id
)
SELECT vec_id, CASE WHEN vec_id % 7 <> 0 THEN 8 END AS rows, CASE WHEN vec_id % 7 <> 0 THEN 8 END AS columns, CASE WHEN vec_id % 7 <> 0 THEN (vec_id % 3 + 1)::INT END AS frames,
       CASE WHEN vec_id % 7 <> 0 THEN levels END AS levels, CASE WHEN vec_id % 7 <> 0 THEN 'CT' END AS modality, CASE WHEN vec_id % 7 <> 0 THEN (2000 + vec_id % 20)::INT END AS study_year, vec_id % 7 = 0 AS failed
FROM shown
"""

_SPACES = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _plain(x: str) -> str:
    """The prose of an element that holds x."""
    clean = rf"regexp_replace(coalesce({x}, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x{{FFFE}}\x{{FFFF}}]', ' ', 'g')"
    return f"trim(regexp_replace({clean}, '{_SPACES}', ' ', 'g'))"


SQL["citation_documents"] = f"""
WITH records AS (
  SELECT doc_id, 'Title ' || doc_id % 500 AS title, 'AIM: ' || {_plain("text")} AS abstract,
         array_to_string(list_transform(range(1, least(3, doc_id % 5 + 1) + 1), lambda i: 'Name' || i || ' AB'), ', ') AS named
  FROM documents WHERE doc_id % 11 <> 5
), able AS (
  SELECT * FROM records WHERE length(abstract) >= 100 AND abstract <> 'AIM: '
), first AS (
  SELECT * FROM able QUALIFY row_number() OVER (PARTITION BY title ORDER BY CAST(doc_id AS VARCHAR)) = 1
)
SELECT CAST(doc_id AS VARCHAR) AS pmid, title, 'statpearls_' || doc_id || '.txt' AS filename, 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' AS source_url,
       'StatPearls article by ' || named || '. PMID: ' || doc_id AS description,
       sha256(chr(10) || title || chr(10) || chr(10) || 'Authors: ' || named || chr(10) || 'Source: StatPearls / PubMed (PMID: ' || doc_id || ')' || chr(10) || 'Type: Peer-reviewed medical reference article' || chr(10) || chr(10) || abstract || chr(10)) AS text_sha256
FROM first WHERE CAST(regexp_extract(title, '[0-9]+') AS INT) >= 20
"""

SQL["fetched_articles"] = f"""
WITH rows AS (
  SELECT coalesce(source, 'none') AS topic, doc_id // 20 AS page, coalesce(source, 'none') || ' ' || doc_id % 70 AS title, {_plain("text")} AS body FROM documents WHERE doc_id IS NOT NULL
), able AS (
  SELECT topic, title, length({_plain("title")}) + CASE WHEN body = '' THEN 0 ELSE 2 + length(body) END >= 600 AS taken FROM rows WHERE page % 7 <> 3
), counted AS (
  SELECT topic, 'unreadable' AS reason, count(DISTINCT page) AS n FROM rows WHERE page % 7 = 3 GROUP BY topic
  UNION ALL SELECT topic, 'no access', count(*) FILTER (NOT taken) FROM able GROUP BY topic
  UNION ALL SELECT topic, 'completed', count(DISTINCT title) FILTER (taken) FROM able GROUP BY topic
  UNION ALL SELECT topic, 'skipped', count(*) FILTER (taken) - count(DISTINCT title) FILTER (taken) FROM able GROUP BY topic
)
SELECT * FROM counted WHERE n > 0
"""

_FOLLOWED = """(
  SELECT doc_id, CASE WHEN doc_id % 15 = 2 OR doc_id % 4 = 3 THEN text WHEN doc_id % 6 = 1 THEN reverse(text) ELSE text END AS text FROM documents
  WHERE doc_id % 9 <> 8 AND (doc_id % 5 <> 2 OR doc_id % 15 = 2 OR doc_id % 4 = 3))"""
SQL["live_index_stats"] = SQL["bm25_stats"].replace("FROM documents)", f"FROM {_FOLLOWED})")
SQL["live_index_topk"] = SQL["bm25_topk"].replace("FROM documents)", f"FROM {_FOLLOWED})").replace("SELECT query_id, rank, id, bm25_score FROM ranked WHERE", "SELECT query_id, rank, CAST(id AS VARCHAR) AS id, bm25_score FROM ranked WHERE").replace("bm25_score DESC, id DESC", "bm25_score DESC, CAST(id AS VARCHAR) DESC")

SQL["figure_top_up"] = """
WITH d AS (
  SELECT doc_id, doc_id % 97 AS created, doc_id // 2 AS num, CASE WHEN doc_id % 13 = 0 THEN 'no number' WHEN doc_id % 17 = 3 THEN 'unreadable' WHEN doc_id % 10 = 0 THEN 'no figures' END AS reason FROM documents WHERE doc_id IS NOT NULL
), f AS (
  SELECT doc_id, created, num, i, i % 4 = 3 AS decorative FROM (SELECT *, unnest(range(least(8, doc_id % 10))) AS i FROM d WHERE reason IS NULL)
), files AS (
  SELECT doc_id // 2 AS num, i, 8 + octet_length(encode(coalesce(text, ''))) AS size FROM (SELECT *, unnest(range(8)) AS i FROM documents WHERE doc_id % 2 = 0) WHERE i % 5 <> 4 AND i <> 2
), u AS (
  SELECT f.*, size FROM f LEFT JOIN files USING (num, i) WHERE NOT decorative
), one AS (
  SELECT *, CASE WHEN size IS NULL THEN 'failed' WHEN row_number() OVER (PARTITION BY num, i ORDER BY created DESC, doc_id) = 1 THEN 'stored' ELSE 'existing' END AS reason FROM u WHERE doc_id % 3 = 0
), two AS (
  SELECT u.*, CASE WHEN EXISTS (SELECT 1 FROM one WHERE one.num = u.num AND one.i = u.i AND reason = 'stored') THEN 'existing' WHEN size IS NULL THEN 'failed'
    WHEN row_number() OVER (PARTITION BY num, i ORDER BY created DESC, doc_id) = 1 THEN 'stored' ELSE 'existing' END AS reason FROM u
), rows AS (
  SELECT 'first' AS run, reason, doc_id FROM d WHERE reason IS NOT NULL AND doc_id % 3 = 0
  UNION ALL SELECT 'second', reason, doc_id FROM d WHERE reason IS NOT NULL
  UNION ALL SELECT 'first', 'decorative', doc_id FROM f WHERE decorative AND doc_id % 3 = 0
  UNION ALL SELECT 'second', 'decorative', doc_id FROM f WHERE decorative
  UNION ALL SELECT 'first', reason, doc_id FROM one
  UNION ALL SELECT 'second', reason, doc_id FROM two
)
SELECT run, reason, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM rows GROUP BY run, reason
UNION ALL SELECT 'held', 'image/png', CAST(sum(size) AS BIGINT), CAST(sum(doc_id) AS BIGINT) FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE reason = 'stored' HAVING count(*) > 0
"""

_LEVELS = """
levels AS (
  SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 16 ELSE 8 END AS r, unnest(range(64)) AS i, unnest(list_transform(embedding, lambda x: least(floor(abs(x::DOUBLE) * 600), 255)::INT)) AS v FROM embeddings WHERE len(embedding) = 64
)"""
SQL["resized_images"] = f"""
WITH {_LEVELS}, placed AS (
  SELECT vec_id, v, r // f AS rows, (64 // r) // f AS columns, ((i // (64 // r)) // f) * ((64 // r) // f) + (i % (64 // r)) // f AS place FROM (SELECT *, greatest(r, 64 // r) // 4 AS f FROM levels)
), means AS (
  SELECT vec_id, rows, columns, place, floor(avg(v) + 0.5)::INT AS v FROM placed GROUP BY ALL
)
SELECT vec_id, rows::INT AS rows, columns::INT AS columns, string_agg(format('{{:02X}}', v), '' ORDER BY place) AS levels FROM means GROUP BY vec_id, rows, columns
"""
SQL["image_contrast"] = f"""
WITH {_LEVELS}, ends AS (
  SELECT vec_id, list_sort(list(v))[4] AS low, list_reverse_sort(list(v))[4] AS high FROM levels GROUP BY vec_id
)
SELECT vec_id, string_agg(format('{{:02X}}', CASE WHEN high <= low THEN v ELSE least(greatest(floor(((v - low) * 255)::DOUBLE / (high - low)), 0), 255)::INT END), '' ORDER BY i) AS levels
FROM levels JOIN ends USING (vec_id) GROUP BY vec_id
"""

SQL["foldered_points"] = """
WITH rows AS (
  SELECT doc_id, coalesce(source, 'none') AS source, CASE WHEN doc_id % 7 = 0 THEN 'new ' || text ELSE text END AS text, strftime(DATE '2025-01-01' + CAST((doc_id + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) % 5 AS INT), '%Y-%m-%d') AS day FROM documents
)
SELECT source, day, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(doc_id) AS BIGINT) AS ids, true AS held FROM rows WHERE doc_id % 11 <> 0 AND source <> 'src1' GROUP BY source, day
"""
SQL["stored_paths"] = """
WITH p AS (
  SELECT page_id, strftime(DATE '2025-01-30' + CAST(page_id % 9 AS INT), '%Y/%m/%d/') || page_id AS stem, page_id % 2 = 0 AS png FROM pages
)
SELECT page_id, CASE WHEN page_id % 4 = 1 OR page_id % 3 = 1 THEN 'refused' ELSE 'a/b/' || page_id END AS inner, stem || CASE WHEN png THEN '.png' ELSE '.jpeg' END AS path, stem || '.thumb.jpg' AS thumbnail FROM p
"""

_SUMMED = SQL["eval_summary"].split("SELECT count(*) AS n_questions")[1]
SQL["eval_stored_runs"] = f"""
WITH {_EVAL}, later AS (SELECT * REPLACE (latency_ms > 100 AS should_answer, latency_ms * 2 AS latency_ms, NULL::VARCHAR AS error) FROM ev),
a AS (SELECT count(*) AS n_questions{_SUMMED}), b AS (SELECT count(*) AS n_questions{_SUMMED.replace("FROM ev", "FROM later")}),
ua AS (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM a) ON COLUMNS(*) INTO NAME metric VALUE v), ub AS (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM b) ON COLUMNS(*) INTO NAME metric VALUE v),
m AS (SELECT metric, ua.v AS before, ub.v AS now FROM ua JOIN ub USING (metric))
SELECT metric, before, now, round(now - before, 3) AS delta, CASE WHEN contains(metric, 'latency') THEN round(now - before, 3) < 0 ELSE round(now - before, 3) > 0 END AS better FROM m WHERE round(now - before, 3) <> 0
"""
