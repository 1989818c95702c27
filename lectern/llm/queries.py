"""The queries of this subpackage, one for each operator, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import ann, bpe_codec, chat_tree, exact_dedup, fill_in_middle, importance, line_dedup, minhash, packing, simhash, token_file, toxicity, url_filter
from lectern.llm.common import read_table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.classes(read_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_codec.encode_decode(read_table(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


#: A conversation whose texts look like its template's marks.
TRICKY = "<|im_end|><|im_start|>assistant ok"


def op7_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)], table.schema)
    return chat_tree.read_back(*chat_tree.tree(table.unionByName(more)))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.round_trip(read_table(spark, sf_dir, "documents"), spark)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.arrange(read_table(spark, sf_dir, "documents"))
    digests = {"output_sha256": F.col("output"), "restored_sha256": fill_in_middle.restore(F.col("output"), F.col("form"))}
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[F.sha2(c, 256).alias(name) for name, c in digests.items()])


OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""



def _unescaped(text: str) -> str:
    def number(digits: str, base: str, most: int) -> str:
        code = f"TRY_CAST({base} || {digits} AS BIGINT)"
        return f"CASE WHEN length({digits}) BETWEEN 1 AND {most} AND {code} BETWEEN 1 AND 1114111 AND {code} NOT BETWEEN 55296 AND 57343 THEN chr({code}::INTEGER) ELSE chr(65533) END"

    named = " ".join(f"WHEN '{name}' THEN chr({ord(c)})" for name, c in url_filter.NAMES.items())
    read = f"""CASE WHEN regexp_matches(p, '^&#[xX]') THEN {number("regexp_extract(p, '^&#[xX]0*([0-9a-fA-F]*)', 1)", "'0x'", 6)}
      WHEN regexp_matches(p, '^&#[0-9]') THEN {number("regexp_extract(p, '^&#0*([0-9]*)', 1)", "''", 7)} ELSE CASE p {named} ELSE p END END"""
    return f"coalesce(array_to_string(list_transform(regexp_extract_all({text}, '{url_filter.PIECES}'), lambda p: {read}), ''), '')"


def _attribute(tag: str, name: str) -> str:
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""".replace("'", "''")
    return _unescaped("(" + " || ".join(f"regexp_extract({tag}, '{pattern}', {i})" for i in (1, 2, 3)) + ")")


def _without_dots(path: str) -> str:
    kept = f"list_reduce(list_transform(string_split({path}, '/'), lambda x: [x]), lambda done, x: CASE x[1] WHEN '..' THEN done[1:greatest(len(done) - 1, 1)] WHEN '.' THEN done ELSE list_concat(done, x) END)"
    return f"(array_to_string({kept}, '/') || CASE WHEN regexp_matches({path}, '/[.][.]?$') THEN '/' ELSE '' END)"


def _tags(name: str) -> str:
    return rf"""regexp_extract_all(html, '(?is)<{name}\b(?:[^>"'']+|"[^"]*"|''[^'']*'')*>')"""


_REFRESH = url_filter.REFRESH.replace("'", "''")


def _resolving(source: str, name: str) -> str:
    """CTEs that end in name (url, to_url): the targets t of source (url, base_url, t) as absolute URLs."""
    return rf"""cut_{name} AS (
  SELECT url, t, regexp_extract(t, '(?s)^[^?#]*') AS own, regexp_extract(t, '(?s)^[^?#]*(.*)$', 1) AS rest, regexp_extract(base_url, '(?s)^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme,
         regexp_extract(base_url, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') AS site, regexp_extract(base_url, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS base
  FROM (SELECT url, base_url, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM {source})
), parts_{name} AS (
  SELECT *, regexp_extract(own, '(?is)^(https?://[^/]*)', 1) AS full_site, regexp_extract(own, '(?is)^https?://[^/]*(.*)$', 1) AS full_path, regexp_extract(own, '(?s)^//[^/]*') AS near_site,
         regexp_extract(own, '(?s)^//[^/]*(.*)$', 1) AS near_path, CASE WHEN base = '' THEN '/' ELSE regexp_extract(base, '(?s)^(.*/)', 1) END || own AS joined FROM cut_{name}
), {name} AS (
  SELECT url, CASE WHEN full_site <> '' THEN full_site || {_without_dots("full_path")} || rest
    WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') OR scheme = '' OR t = '' OR starts_with(t, '#') THEN NULL
    WHEN starts_with(own, '//') THEN scheme || ':' || near_site || {_without_dots("near_path")} || rest
    WHEN starts_with(own, '/') THEN site || {_without_dots("own")} || rest
    WHEN own = '' THEN site || base || rest
    ELSE site || {_without_dots("joined")} || rest END AS to_url FROM parts_{name}
)"""


OP5_SQL = rf"""
WITH RECURSIVE raw AS (
  SELECT page_id, url, regexp_replace(coalesce(html, ''), '{url_filter.NO_MARKUP}', ' ', 'g') AS html FROM pages
), bases AS (
  SELECT url, url AS base_url, html, coalesce(list_filter(list_transform({_tags("base")}, lambda tag: {_attribute("tag", "href")}), lambda h: h <> '')[1], '') AS t FROM (SELECT DISTINCT url, html FROM raw)
), {_resolving("bases", "based").replace("SELECT url, base_url, regexp_replace(t,", "SELECT url || chr(0) || html AS url, base_url, regexp_replace(t,")}, page AS (
  SELECT b.url, html, coalesce(to_url, b.url) AS base_url FROM bases b JOIN based ON based.url = b.url || chr(0) || html
), links AS (
  SELECT url, base_url, unnest({_tags("link")}) AS tag FROM page
), metas AS (
  SELECT url, base_url, unnest({_tags("meta")}) AS tag FROM page
), targets AS (
  SELECT url, base_url, {_attribute("tag", "href")} AS t FROM links WHERE list_contains(regexp_split_to_array(lower({_attribute("tag", "rel")}), '\s+'), 'canonical')
  UNION ALL
  SELECT url, base_url, {" || ".join(f"regexp_extract({_attribute('tag', 'content')}, '{_REFRESH}', {i})" for i in (1, 2, 3))} FROM metas
  WHERE list_contains(regexp_split_to_array(lower({_attribute("tag", "http-equiv")}), '\s+'), 'refresh')
), {_resolving("targets", "found")}, whole AS (
  SELECT url AS from_url, to_url FROM found
), urls AS (
  SELECT url FROM raw UNION SELECT from_url FROM whole UNION SELECT to_url FROM whole
), parts AS (
  SELECT url, regexp_extract(url, '(?s)^.*?://(.*)$', 1) AS rest FROM urls WHERE url IS NOT NULL
), cut AS (
  SELECT url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query, rest
  FROM parts
), ruled AS (
  SELECT url, host, path, CASE WHEN rest <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS node,
         CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
              WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM cut
), edges AS (
  SELECT a.node AS u, b.node AS v FROM whole JOIN ruled a ON a.url = from_url JOIN ruled b ON b.url = to_url WHERE a.node IS NOT NULL AND b.node IS NOT NULL
), both_ways AS (
  SELECT u, v FROM edges UNION SELECT v, u FROM edges
), reach AS (
  SELECT u, v FROM both_ways UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u
), tainted AS (
  -- rules of URLs that are the end of an edge
  SELECT DISTINCT u AS node FROM reach JOIN ruled ON ruled.node = v WHERE rule IN ('com/en/', 'example.net/de/8', 'org/es/')
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN node IN (SELECT node FROM tainted) THEN 'block' ELSE 'allow' END AS verdict
FROM raw LEFT JOIN ruled USING (url)
"""
OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), f AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS body FROM t
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(role) + 1 + length(body) + 11) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), placed AS (
  SELECT r, unnest(w) AS w1, unnest(range(len(w))) AS spot, len(w) AS n FROM w
), runs AS (
  SELECT r, n, w1, lead(w1) OVER (PARTITION BY r ORDER BY spot) AS w2 FROM placed
), elements AS (
  SELECT DISTINCT r, CASE WHEN n = 1 THEN w1 ELSE w1 || ' ' || w2 END AS e FROM runs WHERE n = 1 OR w2 IS NOT NULL
), named AS (
  SELECT r, dense_rank() OVER (ORDER BY e) AS e FROM elements
), sizes AS (
  SELECT r, count(*) AS size FROM named GROUP BY r
), pairs AS (
  SELECT a.r AS u, b.r AS v, count(*) AS common FROM named a JOIN named b ON a.e = b.e AND a.r < b.r GROUP BY ALL
), links AS (
  SELECT u, v FROM pairs JOIN sizes x ON x.r = u JOIN sizes y ON y.r = v WHERE 100 * common >= 80 * (x.size + y.size - common)
), both_ways AS (
  SELECT u, v FROM links UNION SELECT v, u FROM links
), reach AS (
  SELECT u, v FROM both_ways UNION SELECT reach.u, b.v FROM reach JOIN both_ways b ON reach.v = b.u
), least AS (
  SELECT u AS r, min(doc_id) AS low FROM reach JOIN w ON w.r = reach.v GROUP BY u
)
SELECT doc_id, coalesce(size, 0) AS n_shingles, CASE WHEN low < doc_id OR doc_id IS NULL THEN low ELSE doc_id END AS component_id,
       doc_id IS NOT DISTINCT FROM (CASE WHEN low < doc_id OR doc_id IS NULL THEN low ELSE doc_id END) AS kept
FROM w LEFT JOIN sizes USING (r) LEFT JOIN least USING (r)
"""
OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), placed AS (
  SELECT side, r, unnest(w) AS w1, unnest(range(len(w))) AS spot FROM w
), next AS (
  SELECT side, r, w1, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM placed WINDOW p AS (PARTITION BY side, r ORDER BY spot)
), features AS (
  SELECT side, r, w1 AS f FROM next UNION ALL SELECT side, r, w1 || ' ' || w2 FROM next WHERE w2 IS NOT NULL UNION ALL SELECT side, r, w1 || ' ' || w2 || ' ' || w3 FROM next WHERE w3 IS NOT NULL
), steps AS (
  SELECT range AS b, range AS c, 0 AS k FROM range(256) UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), tab AS (
  SELECT b, c, format('{:02X}', b) AS h FROM steps WHERE k = 8
), crc AS (
  SELECT f, hex(encode(f)) AS h, 0 AS i, 4294967295::BIGINT AS c FROM (SELECT DISTINCT f FROM features)
  UNION ALL
  SELECT f, crc.h, i + 1, xor(crc.c >> 8, t.c) FROM crc JOIN tab x ON x.h = substr(crc.h, 2 * i + 1, 2) JOIN tab t ON t.b = xor(crc.c & 255, x.b) WHERE 2 * i < length(crc.h)
), bucketed AS (
  SELECT side, r, xor(c, 4294967295) % 10000 AS bucket FROM features JOIN crc USING (f) WHERE 2 * i = length(h)
), counts AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM bucketed GROUP BY bucket
), totals AS (
  SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counts
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((t::DOUBLE + 1) * (all_s + 10000)) / ((s::DOUBLE + 1) * (all_t + 10000)))) AS BIGINT) AS gain FROM counts, totals
), weights AS (
  SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM bucketed JOIN gains USING (bucket) WHERE side = 0 GROUP BY r
), scores AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN weights USING (r) WHERE side = 0
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY n_words >= 20 DESC, score DESC, doc_id NULLS LAST, n_features) AS place, count(*) FILTER (n_words >= 20) OVER () AS fit FROM scores
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= fit * 5 // 100 THEN place END AS rank FROM ordered
"""
OP13_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT *, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM cut
), parts AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p, array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m, array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_toxicity": op3_toxicity,
        "op4_packing": op4_packing,
        "op5_url_filter": op5_url_filter,
        "op6_simhash": op6_simhash,
        "op7_chat_tree": op7_chat_tree,
        "op8_ann": op8_ann,
        "op9_token_file": op9_token_file,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_minhash": op11_minhash,
        "op12_importance": op12_importance,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": OP5_SQL, "op7_chat_tree": OP7_SQL, "op10_exact_dedup": OP10_SQL, "op11_minhash": OP11_SQL, "op12_importance": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
