"""Queries that write given tables, or recorded replies made of them, and read them back through a source; each with its SQL over the tables themselves."""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import benchmarks, checks, entities
from .queries import query, t
from .shared import shared_folder
from .sources import audience, files, pages, resultbook, search

C = F.col


def scratch(spark, name: str) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


#: Line breaks, quotes and separators in the text columns.
ODD_NAME = "p_name || CASE p_partkey % 4 WHEN 0 THEN ' \"q\", ' || chr(10) || 'x' WHEN 1 THEN '' WHEN 2 THEN ', é' ELSE ' \\ ' END"


def odd_parts(spark, d) -> DataFrame:
    k = C("p_partkey") % 4
    return t(spark, d, "part").select(C("p_partkey").cast("string").alias("p_partkey"), F.concat("p_name", F.when(k == 0, ' "q", \nx').when(k == 1, "").when(k == 2, ", é").otherwise(" \\ ")).alias("odd"), F.when(C("p_size") % 5 != 0, C("p_brand")).alias("brand"))


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, {ODD_NAME} AS odd, CASE WHEN p_size % 5 != 0 THEN p_brand END AS brand FROM part")
def csv_text_round_trip(spark, d):
    """S1, S4, S5: text columns with line breaks, doubled quotes and blanks, in a declared order."""
    path = scratch(spark, "csv")
    files.write_csv(odd_parts(spark, d).withColumn("extra", F.lit("left out")), path, ["p_partkey", "odd", "brand"])
    return checks.require_columns(files.read_csv(spark, path, ["p_partkey", "odd", "brand"]), ["p_partkey", "odd", "brand"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 != 0 THEN o_totalprice END AS price, CAST(CASE WHEN o_orderkey % 7 != 0 THEN o_custkey END AS INTEGER) AS cust, CASE WHEN o_orderkey % 3 != 0 THEN o_orderpriority END AS priority FROM orders")
def csv_typed_round_trip(spark, d):
    """S2, S3: declared types; NA, None, null and texts that are no numbers are missing, as are levels that are not declared."""
    from .functions.scalars import factor

    path, k = scratch(spark, "csv"), C("o_orderkey")
    levels = [r[0] for r in t(spark, d, "orders").select("o_orderpriority").distinct().limit(1000).collect()]
    rows = t(spark, d, "orders").select(k.cast("string"), F.when(k % 5 == 0, "NA").otherwise(C("o_totalprice").cast("string")).alias("price"), F.when(k % 7 == 0, F.when(k % 2 == 0, "None").otherwise("x1")).otherwise(C("o_custkey").cast("string")).alias("cust"), F.when(k % 3 == 0, "undeclared").otherwise(C("o_orderpriority")).alias("priority"))
    files.write_csv(rows, path, rows.columns)
    kinds = T.StructType().add("o_orderkey", T.LongType()).add("price", T.DoubleType()).add("cust", T.IntegerType()).add("priority", T.StringType())
    return files.read_typed_csv(spark, path, kinds).withColumn("priority", factor(C("priority"), levels))


@query("SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 4 != 0 THEN c_mktsegment END AS segment, n AS orders FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def json_round_trip(spark, d):
    """S7: nested JSON with nulls, read under a declared schema."""
    path = scratch(spark, "json")
    n = t(spark, d, "orders").groupBy(C("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    rows = t(spark, d, "customer").join(n, "c_custkey").select("c_custkey", F.struct("c_name", "c_acctbal", F.when(C("c_custkey") % 4 != 0, C("c_mktsegment")).alias("segment")).alias("who"), "orders")
    files.write_json(rows, path)
    return files.read_json(spark, path, rows.schema).select("c_custkey", "who.c_name", "who.c_acctbal", "who.segment", "orders")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem")
def verified_write(spark, d):
    """S6, S14: written atomically, read again and compared with its source, repeats counted."""
    return files.write_verified(t(spark, d, "lineitem"), scratch(spark, "verified"), ["l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"])


#: Terms of a search, with the brands that they serve; orders in the place of the ads found, customers of their pages.
TERMS = [("first", "URGENT"), ("first", "HIGH"), ("second", "HIGH"), ("second", "LOW")]
SQL_HITS = f"""SELECT brand, term_at, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN c_mktsegment ELSE c_name END AS page_name, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey
 JOIN (VALUES {", ".join(f"('{b}', '{term}', {k})" for k, (b, term) in enumerate(TERMS))}) v(brand, term, term_at) ON o_orderpriority LIKE '%-' || term WHERE o_orderkey % 11 != 0"""


def recorded_search(spark, d) -> DataFrame:
    path = scratch(spark, "search")
    ads = t(spark, d, "orders").join(t(spark, d, "customer").select(C("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"), "o_custkey")
    page = F.when(C("o_orderkey") % 11 != 0, F.concat(F.lit(" "), C("o_custkey").cast("string"), F.lit(" "))).otherwise("")
    ad = F.struct(page.alias("page_id"), F.when(C("o_orderkey") % 5 == 0, C("c_mktsegment")).otherwise(C("c_name")).alias("page_name"))
    search.record(ads.select(F.regexp_replace("o_orderpriority", "^.*-", "").alias("term"), C("o_orderkey").alias("at"), ad.alias("ad")), path)
    return search.search_pages(spark, TERMS, dir=path, limit=250, most=1_000_000, page_delay=0)


@query(f"""SELECT brand AS search_brand, CAST(o_custkey AS VARCHAR) AS page_id, count(*) AS ad_count, arg_max(page_name, CAST(term_at AS BIGINT) * 1000000000000 + o_orderkey) AS page_name FROM ({SQL_HITS}) GROUP BY ALL""")
def searched_pages(spark, d):
    """S10: recorded results of search terms, read page by page, tallied over a brand's terms with the name seen last."""
    return search.candidates(recorded_search(spark, d))


@query(f"""WITH p AS (SELECT brand, o_custkey, count(*) AS n FROM ({SQL_HITS}) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY n DESC, CAST(o_custkey AS VARCHAR)) AS k, max(n) OVER (PARTITION BY brand) AS best FROM p)
 SELECT brand AS search_brand, CAST(o_custkey AS VARCHAR) AS page_id, n AS ad_count, k AS rank, count(*) FILTER (n = best) OVER (PARTITION BY brand) > 1 AS ambiguous FROM r QUALIFY k <= 8""")
def searched_candidates(spark, d):
    """S10 with the choice that follows: the eight pages with most ads of each brand, and whether the first is tied."""
    found = search.candidates(recorded_search(spark, d))
    return entities.top_candidates(found, "search_brand", "ad_count", ["page_id"]).select("search_brand", "page_id", "ad_count", "rank", "ambiguous")


SCOPES = {"facebook_instagram": ["facebook", "instagram"], "facebook_only": ["facebook"], "instagram_only": ["instagram"]}
GENDERS = {"all": None, "male": [1], "female": [2]}
BANDS = [("18-24", 18, 24), ("25-34", 25, 34), ("35-44", 35, 44), ("45-54", 45, 54), ("55-64", 55, 64), ("65+", 65, 65)]
#: A customer's age, gender and platform, of its key and nation.
SQL_AUDIENCE = f"""SELECT s AS platform_scope, g AS gender, b AS age_band, CAST(lo AS INTEGER) AS age_min, CAST(hi AS INTEGER) AS age_max, n AS low, n + CAST(floor(m / 1000) AS BIGINT) AS high FROM
 (SELECT s, g, b, lo, hi, count(c_custkey) AS n, coalesce(sum(abs(c_acctbal)), 0) AS m FROM (VALUES ('facebook_instagram', 2), ('facebook_only', 0), ('instagram_only', 1)) x(s, sk) CROSS JOIN (VALUES ('all', 0), ('male', 1), ('female', 2)) y(g, gk)
 CROSS JOIN (VALUES ('18-65+', 18, 65), {", ".join(f"('{b}', {lo}, {hi})" for b, lo, hi in BANDS)}) z(b, lo, hi) LEFT JOIN customer ON (sk = 2 OR c_nationkey % 2 = sk) AND (gk = 0 OR c_custkey % 2 + 1 = gk) AND 18 + c_custkey % 48 BETWEEN lo AND hi GROUP BY ALL)"""


def recorded_estimates(spark, d) -> DataFrame:
    """Replies to all 63 requests, made of the customers that each one asks for, and collected from them."""
    path = scratch(spark, "audience")
    grid = pages.request_grid(spark, SCOPES, GENDERS, BANDS)
    who = t(spark, d, "customer").select("c_custkey", "c_acctbal", F.when(C("c_nationkey") % 2 == 0, "facebook").otherwise("instagram").alias("platform"), (C("c_custkey") % 2 + 1).cast("int").alias("sex"), (18 + C("c_custkey") % 48).alias("age"))
    asked = F.array_contains("platforms", C("platform")) & (C("gender_values").isNull() | F.array_contains("gender_values", C("sex"))) & C("age").between(C("age_min"), C("age_max"))
    people = F.broadcast(grid).join(who, asked).groupBy(*grid.columns).agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("c_acctbal")).alias("m"))
    found = {tuple(r[c] for c in ("platform_scope", "gender", "age_band")): (r["n"], int(r["m"] // 1000)) for r in people.collect()}  # a row a request
    lines = []
    for r in grid.collect():
        n, m = found.get((r["platform_scope"], r["gender"], r["age_band"]), (0, 0))
        body = {"data": [{"estimate_mau_lower_bound": n, "estimate_mau_upper_bound": n + m}]}
        lines.append((json.dumps({"targeting_spec": audience.targeting(r.asDict(), "DE")["targeting_spec"], "body": body}),))
    spark.createDataFrame(lines, "value string").write.text(f"{path}/replies")
    return audience.collect_estimates(spark, f"{path}/table", grid, batch=40, dir=f"{path}/replies", version="v1")


@query(f"SELECT 'DE' AS country, platform_scope, gender, age_band, age_min, age_max, low AS estimate_mau_lower_bound, high AS estimate_mau_upper_bound, CAST(round_even((low + high) / 2, 0) AS BIGINT) AS estimate_mau_midpoint, 'v1' AS api_version FROM ({SQL_AUDIENCE})")
def audience_estimates(spark, d):
    """S11: the grid of 63 requests, answered from recorded replies."""
    return recorded_estimates(spark, d).drop("collected_at_utc")


@query(f"""WITH a AS ({SQL_AUDIENCE}), g AS (SELECT platform_scope, max(low) FILTER (gender = 'female') AS fl, max(high) FILTER (gender = 'female') AS fh, max(low) FILTER (gender = 'male') AS ml, max(high) FILTER (gender = 'male') AS mh FROM a WHERE age_band = '18-65+' GROUP BY ALL),
 r AS (SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'facebook_only' ELSE 'instagram_only' END AS platform_scope, c_mktsegment, CAST(count(*) FILTER (c_custkey % 2 = 1) AS DOUBLE) / count(*) AS share FROM customer GROUP BY ALL)
 SELECT c_mktsegment, r.platform_scope, round(100 * share, 6) AS share_percent, round(100 * (share - fl / CAST(fl + mh AS DOUBLE)), 6) AS above_lower, round(100 * (share - fh / CAST(fh + ml AS DOUBLE)), 6) AS above_upper FROM r JOIN g USING (platform_scope)""")
def audience_gaps(spark, d):
    """S11 with its use: the bounds of the estimates, against shares of a given table."""
    bounds = benchmarks.share_bounds(recorded_estimates(spark, d).where("age_band = '18-65+'")).withColumnRenamed("benchmark_scope", "platform_scope")
    scope = F.when(C("c_nationkey") % 2 == 0, "facebook_only").otherwise("instagram_only").alias("platform_scope")
    shares = t(spark, d, "customer").groupBy(scope, "c_mktsegment").agg((F.count_if(C("c_custkey") % 2 == 1) / F.count(F.lit(1))).alias("share"))
    pp = lambda x: F.round(100 * x, 6)
    return shares.join(bounds, "platform_scope").select("c_mktsegment", "platform_scope", pp(C("share")).alias("share_percent"), pp(C("share") - C("benchmark_lower")).alias("above_lower"), pp(C("share") - C("benchmark_upper")).alias("above_upper"))


def event_sums(spark, d) -> DataFrame:
    return t(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def result_book_sheet(spark, d):
    """S12: a result of a few rows, put into a workbook under a title and read from its sheet."""
    import tempfile

    book = resultbook.ResultBook()
    book.put("other", "before", ["a"], [(1,)])
    book.put_frame("events", "By type", event_sums(spark, d).orderBy("event_type"))
    with tempfile.TemporaryDirectory() as folder:  # of the driver, which writes and reads the book
        book.save(f"{folder}/book.xlsx")
        title, names, *rows = resultbook.read_sheet(f"{folder}/book.xlsx", "events")
    assert title == ["By type"] and names == ["event_type", "n", "total"]
    return spark.createDataFrame([(e, int(n), float(x)) for e, n, x in rows], "event_type string, n long, total double")


@query("""WITH m AS (SELECT count(*) AS a, count(DISTINCT user_id) AS b FROM events) SELECT 0 AS line, 'Events' AS text UNION ALL SELECT 1, '======' UNION ALL SELECT 2, 'rows            ' || format('{:,}', a) FROM m UNION ALL SELECT 3, 'distinct users  ' || format('{:,}', b) FROM m""")
def text_report_lines(spark, d):
    """S8: the lines of a text report."""
    r = t(spark, d, "events").agg(F.count(F.lit(1)), F.countDistinct("user_id")).first()
    lines = resultbook.text_report("Events", [("rows", r[0]), ("distinct users", r[1])]).splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")
