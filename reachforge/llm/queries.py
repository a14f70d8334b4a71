"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, chat_format, decontaminate, exact_dedup, html_extract, lexical_search, license_scan, line_dedup, ngram_join, quality_rules, token_counts, toxicity, vector_codes
from .common import read


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql("""SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)""")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.chat_digest(turns)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(read(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(read(spark, sf_dir, "documents"), n=4, percent=85)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a directory tree; those that open or close with a notice speak for their directory."""
    docs = read(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("id"), license_scan.document_path().alias("path"), "text")
    ends = F.concat(F.regexp_extract("text", r"^\s*([^\n]*)", 1), F.lit(" "), F.substring_index(F.rtrim("text", F.lit(" \t\r\n")), "\n", -1)).rlike(license_scan.NOTICE)
    return license_scan.scan_licenses(files, F.coalesce(ends, F.lit(False))).withColumnRenamed("id", "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_documents(read(spark, sf_dir, "documents"))


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(read(spark, sf_dir, "documents"))


def op13_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_chat_formatting, op2_html_extraction, op3_token_counts, op4_quality_rules, op5_line_dedup, op6_ngram_jaccard_join, op7_benchmark_decontamination, op8_license_scan, op9_toxicity, op10_bpe_codec, op11_ranked_lexical_search, op12_exact_dedup, op13_vector_code_compression)
}


def chat_sql(t: chat_format.Template) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def escaped(x: str) -> str:
        out = f"replace({x}, {quote(t.escape)}, {quote(2 * t.escape)})"
        for c in t.controls:
            out = f"replace({out}, {quote(c)}, {quote(c[0] + t.escape + c[1:])})"
        return out

    marks = len(t.open) + len(t.mid) + len(t.close)
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum({marks} + length({escaped("role")}) + length({escaped("text")})) AS BIGINT) AS formatted_chars,
 regexp_full_match(string_agg(role, ',' {order}), '(system,)?user(,assistant,user)*(,assistant)?') AS valid FROM c GROUP BY conv_id"""


#: Not by windows, as the operator has it, but by maximal matches: equal lines of two places side by side on a diagonal.
LINES_SQL = rf"""WITH a AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
 l AS (SELECT *, len(regexp_extract_all(line, '[^ 	-
]+')) AS w FROM a), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE w > 0),
 m AS (SELECT x.doc_id AS a, x.k AS i, y.doc_id AS b, y.k AS j, y.w FROM k x JOIN k y ON x.line = y.line AND (x.doc_id < y.doc_id OR x.doc_id = y.doc_id AND x.k < y.k)),
 n AS (SELECT *, i - row_number() OVER (PARTITION BY a, b, j - i ORDER BY i) AS island FROM m), r AS (SELECT b, min(j) AS s, max(j) AS e FROM n GROUP BY a, b, j - i, island HAVING sum(w) >= {line_dedup.MIN_WORDS}),
 g AS (SELECT DISTINCT k.doc_id, k.i FROM (SELECT DISTINCT b, s, e FROM r) r JOIN k ON k.doc_id = r.b AND k.k BETWEEN s AND e)
 SELECT l.doc_id, CASE WHEN count(g.i) > 0 AND count(g.i) = count(*) FILTER (w > 0) THEN '' ELSE coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') END AS text, count(*) FILTER (w > 0) AS n_lines, count(g.i) AS n_deleted
 FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id"""

JOIN_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
 g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON s.a = r.b)
 SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = w.doc_id"""

EXACT_SQL = r"""WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents),
 r AS (SELECT doc_id, plain, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY plain) AS group_size FROM n WINDOW w AS (PARTITION BY plain ORDER BY size DESC, doc_id NULLS LAST))
 SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(plain) AS text_sha256 FROM r"""

#: Every document against every item.
SEARCH_SQL = rf"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
 i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
 q AS (SELECT item_id, t, count(*) AS often FROM i GROUP BY ALL), f AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL), n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY doc_id),
 g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM n), w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, g GROUP BY t),
 s AS (SELECT item_id, doc_id, CAST(sum(often * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // length)))) AS BIGINT) AS score FROM q JOIN f USING (t) JOIN w USING (t) JOIN n USING (doc_id), g GROUP BY ALL),
 r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0) SELECT * FROM r WHERE rank <= {lexical_search.TOP}"""


def codes_sql() -> str:
    """Every part against every entry, round by round."""
    rounds, parts, entries, scale = vector_codes.ROUNDS, vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.SCALE
    # the nearest entry and its distance as one number, the lower index first
    near = lambda k: f"""a{k} AS MATERIALIZED (SELECT r, p.p, any_value(p.x) AS x, min(CAST(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i]))) AS BIGINT) * {entries} + e) AS near FROM p JOIN c{k} c ON c.p = p.p GROUP BY r, p.p)"""
    step = lambda k: f"""s{k} AS MATERIALIZED (SELECT p, near % {entries} AS e, i, sum(x[i]) AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS i) GROUP BY ALL),
 c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (SELECT p, e, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{k} GROUP BY p, e) m ON m.p = c.p AND m.e = c.e)"""  # noqa: E731
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS MATERIALIZED (SELECT r, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS x FROM v, (SELECT unnest(range({parts})) AS p)), c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM p WHERE r <= {entries}),
 {", ".join(f"{near(k)}, {step(k)}" for k in range(rounds))}, {near(rounds)},
 o AS (SELECT v.vec_id, v.label, string_agg(printf('%02x', near % {entries}), '' ORDER BY p) AS code, CAST(sum(near // {entries}) AS BIGINT) AS error FROM a{rounds} JOIN v ON v.r = a{rounds}.r GROUP BY v.r, v.vec_id, v.label)
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(x[i] AS VARCHAR), ',' ORDER BY p, e, i)) FROM c{rounds}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS i)) AS codebooks_sha256 FROM o"""


ORACLES: dict[str, str] = {"op1_chat_formatting": chat_sql(chat_format.Template()), "op5_line_dedup": LINES_SQL, "op6_ngram_jaccard_join": JOIN_SQL, "op11_ranked_lexical_search": SEARCH_SQL, "op12_exact_dedup": EXACT_SQL, "op13_vector_code_compression": codes_sql()}
