"""Queries of scalar functions, reconciliation, checks, samples and sources over the driver's tables, each with its SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas as S
from .functions import dates, jsonlist, scalars, text
from .operators import audit, checks, lock, profile, reconcile
from .queries import KEY, LINE_ORDER, query, t
from .shared import shared_folder
from .sources import files, pages

C = F.col


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE printf('%.15g', x) END AS shown, CASE WHEN y = floor(y) THEN CAST(CAST(y AS BIGINT) AS VARCHAR) ELSE printf('%.15g', y) END AS small
 FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_extendedprice * l_discount AS x, l_tax / (l_partkey + 7) AS y FROM lineitem)""")
def number_texts(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (C("l_extendedprice") * C("l_discount")).alias("x"), (C("l_tax") / (C("l_partkey") + 7)).alias("y")).distinct()
    return rows.select("l_orderkey", "l_linenumber", scalars.number_text(C("x")).alias("shown"), scalars.number_text(C("y")).alias("small"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (4, 5) THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 7 < 4 AND o_orderkey % 7 != 2 THEN strftime(o_orderdate, '%Y-%m') END AS month FROM orders""")
def dates_of_odd_texts(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = C("o_orderkey") % 7
    raw = F.when(k == 0, F.concat(day, F.lit("T00:10:00Z"))).when(k == 1, F.concat(day, F.lit("garbage"))).when(k == 2, F.date_format("o_orderdate", "yyyyMMdd")).when(k == 3, F.concat(F.lit("  "), day)).when(k == 4, F.lit("")).when(k == 5, "no date").otherwise(F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss"))
    return t(spark, d, "orders").select("o_orderkey", dates.date_only(raw).alias("day"), dates.month(raw).alias("month"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'a|None|b''c' WHEN 1 THEN 'x|<null>' WHEN 2 THEN '' WHEN 3 THEN 'scalar' WHEN 4 THEN '[broken' ELSE 'True|7' END AS kept, CASE o_orderkey % 6 WHEN 0 THEN 'a|None|b''c' WHEN 1 THEN 'x' WHEN 5 THEN 'True|7' END AS strict,
 CASE o_orderkey % 6 WHEN 0 THEN 'a|b''c|none' WHEN 1 THEN '|x' WHEN 5 THEN '7|true' ELSE CASE o_orderkey % 6 WHEN 2 THEN '' WHEN 3 THEN 'scalar' ELSE '[broken' END END AS structural FROM orders""")
def literal_lists(spark, d):
    k = C("o_orderkey") % 6
    raw = F.when(k == 0, """["a", "None", "b'c"]""").when(k == 1, "['x', None]").when(k == 2, " ").when(k == 3, "scalar").when(k == 4, "[broken").otherwise("[True, 7,]")
    shown = lambda items: F.array_join(items, "|", "<null>")
    return t(spark, d, "orders").select("o_orderkey", shown(jsonlist.parse(raw)).alias("kept"), shown(jsonlist.parse_strict(raw)).alias("strict"), jsonlist.structural(raw, F.lower).alias("structural"))


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' & ' || p_brand || '_é'), '[^\pL\pN_]+', ' ', 'g')) AS page_name, CASE WHEN p_type IN ('ECONOMY', 'LARGE') THEN p_type END AS level, p_size / CAST(p_size + 5 + CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 0 END AS DOUBLE) AS share, '["' || p_brand || '",null]' AS compact FROM part""")
def names_levels_and_shares(spark, d):
    unknown = F.when(C("p_partkey") % 2 == 0, 3)
    fold = lambda c: F.lower(c)
    return t(spark, d, "part").select(
        "p_partkey", text.normalise_d(F.concat(C("p_name"), F.lit(" & "), C("p_brand"), F.lit("_é")), fold).alias("page_name"), scalars.factor(C("p_type"), ["ECONOMY", "LARGE"]).alias("level"),
        scalars.share_with_unknown(C("p_size"), C("p_size") + 5, unknown).alias("share"), jsonlist.compact(F.array("p_brand", F.lit(None).cast("string"))).alias("compact"),
    )


@query("""SELECT *, CASE WHEN m + f > 0 THEN CAST(f AS DOUBLE) / (m + f) END AS female_delivery_share, CASE WHEN a + b > 0 THEN CAST(a AS DOUBLE) / (a + b) END AS adult_18_34_share, CAST(m + f > 0 AS INTEGER) AS gender_data_usable, CAST(a + b > 0 AS INTEGER) AS age_data_usable, CASE WHEN u IS NOT NULL THEN CAST(u > 0 AS INTEGER) END AS has_unknown_gender
 FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) % 4 AS m, l_partkey % 3 AS f, CASE WHEN l_suppkey % 5 != 0 THEN l_suppkey % 2 END AS u, l_partkey % 4 AS a, l_suppkey % 3 AS b FROM lineitem)""")
def derived_shares(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (C("l_quantity").cast("long") % 4).alias("m"), (C("l_partkey") % 3).alias("f"), F.when(C("l_suppkey") % 5 != 0, C("l_suppkey") % 2).alias("u"), (C("l_partkey") % 4).alias("a"), (C("l_suppkey") % 3).alias("b"))
    shares = scalars.share_columns("m", "f", "u", ("a",), ("a", "b"), "u")
    return rows.withColumns(shares).select(*rows.columns, "female_delivery_share", "adult_18_34_share", "gender_data_usable", "age_data_usable", "has_unknown_gender")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 != 0 THEN CAST(p_size AS BIGINT) END AS de_male, CASE WHEN p_size % 3 != 0 THEN 2 * p_size + 7 END AS de_female, CASE WHEN p_size % 3 != 0 THEN CAST(1 AS BIGINT) END AS de_unknown, CASE WHEN p_size % 3 != 0 THEN 3 * p_size END AS de_age_18_24, CASE WHEN p_size % 3 != 0 THEN CAST(8 AS BIGINT) END AS de_age_unknown, CASE WHEN p_size % 3 != 0 THEN CAST(0 AS BIGINT) END AS de_age_25_34 FROM part""")
def country_demographics(spark, d):
    age = lambda name, m, f, u: F.struct(F.lit(name).alias("age_range"), m.cast("long").alias("male"), f.cast("long").alias("female"), u.cast("long").alias("unknown"))
    none, n = F.lit(None), C("p_size").cast("long")
    entry = lambda country, *ages: F.struct(F.lit(country).alias("country"), F.array(*ages).alias("age_gender_breakdowns"))
    other = entry("FR", age("65+", n, n, n))
    mine = entry("DE", age("18-24", n, 2 * n, none), age(" UNKNOWN ", none, F.lit(7), F.lit(1)))
    reach = pages.demographics(F.when(C("p_size") % 3 == 0, F.array(other)).otherwise(F.array(other, mine)), "DE")
    return t(spark, d, "part").select("p_partkey", reach.alias("r")).select("p_partkey", *[C("r")[c].alias(c) for c in ("de_male", "de_female", "de_unknown", "de_age_18_24", "de_age_unknown", "de_age_25_34")])


# Line items in the place of collected versions: an order's line is an id, and its rows are versions of it.
SQL_VERSIONS = """SELECT 'brand ' || l_linenumber AS search_brand, CAST(l_orderkey AS VARCHAR) AS meta_ad_id, '["' || l_returnflag || '"]' AS body, '["' || l_linestatus || '"]' AS platform, CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS stop, strftime(l_shipdate, '%Y-%m-%d') AS ts,
 CAST(l_partkey AS VARCHAR) AS qmin, CAST(l_suppkey AS VARCHAR) AS qmax, CAST(round(l_extendedprice * 100) AS BIGINT) AS seq, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS male FROM lineitem"""
_ORDER = "ts DESC, qmin, qmax, seq"


def versions(spark, d) -> DataFrame:
    blank = F.lit("")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    own = {
        "search_brand": F.concat(F.lit("brand "), C("l_linenumber").cast("string")), "sector": F.lit("home"), "meta_ad_id": C("l_orderkey").cast("string"), "ad_creative_bodies": F.concat(F.lit('["'), "l_returnflag", F.lit('"]')),
        S.PLATFORMS: F.concat(F.lit('["'), "l_linestatus", F.lit('"]')), S.STOP: F.when(C("l_suppkey") % 3 == 0, "").otherwise(day), "collection_timestamp": day, "de_male": F.when(C("l_partkey") % 4 == 0, "").otherwise(C("l_quantity").cast("long").cast("string")),
        "_query_date_min": C("l_partkey").cast("string"), "_query_date_max": C("l_suppkey").cast("string"), "_seq": F.round(C("l_extendedprice") * 100).cast("long"),
    }
    return t(spark, d, "lineitem").select(*[own.get(c, blank).alias(c) for c in [*S.RAW, "_query_date_min", "_query_date_max", "_seq"]])


@query(f"""SELECT search_brand, meta_ad_id, arg_min(body, k) AS ad_creative_bodies, CASE WHEN count(*) > 1 THEN to_json(list_sort(list(DISTINCT platform[3:-3]))) ELSE any_value(platform) END AS publisher_platforms, coalesce(arg_min(stop, k) FILTER (stop != ''), '') AS {S.STOP}, arg_min(ts, k) AS collection_timestamp, coalesce(arg_min(male, k) FILTER (male != ''), '') AS de_male
 FROM (SELECT *, row_number() OVER (PARTITION BY search_brand, meta_ad_id ORDER BY {_ORDER}) AS k FROM ({SQL_VERSIONS})) GROUP BY ALL""")
def reconciled_versions(spark, d):
    """The whole reconciliation: the latest row of an id, with demographics and stop from the latest version that has them, and all platforms."""
    final, _, _ = reconcile.reconcile(versions(spark, d))
    return final.select("search_brand", "meta_ad_id", "ad_creative_bodies", S.PLATFORMS, S.STOP, "collection_timestamp", "de_male")


SQL_CHANGES = f"""SELECT search_brand, meta_ad_id, 'creative' AS difference_tier, 'ad_creative_bodies' AS differing_field, b0 AS earlier_value, body AS later_value, ts AS later_collection_timestamp FROM
 (SELECT *, lag(body) OVER (PARTITION BY search_brand, meta_ad_id ORDER BY ts, qmin, qmax, seq) AS b0 FROM ({SQL_VERSIONS})) WHERE b0 != body"""


@query(SQL_CHANGES)
def reconciliation_conflicts(spark, d):
    _, conflicts, _ = reconcile.reconcile(versions(spark, d))
    return conflicts.select("search_brand", "meta_ad_id", "difference_tier", "differing_field", "earlier_value", "later_value", "later_collection_timestamp")


@query(f"SELECT 'total' AS kind, 'conflict_rows' AS label, count(*) AS n FROM ({SQL_CHANGES}) UNION ALL SELECT 'total', 'conflict_ids', count(DISTINCT meta_ad_id) FROM ({SQL_CHANGES}) UNION ALL SELECT 'difference_tier', difference_tier, count(*) FROM ({SQL_CHANGES}) GROUP BY ALL UNION ALL SELECT 'differing_field', differing_field, count(*) FROM ({SQL_CHANGES}) GROUP BY ALL")
def conflict_profile(spark, d):
    _, conflicts, _ = reconcile.reconcile(versions(spark, d))
    return profile.audit_profile(conflicts)


@query(f"""SELECT search_brand, meta_ad_id, qmin AS query_date_min, ts AS collection_timestamp, male AS de_male FROM (SELECT *, count(DISTINCT (stop, male)) OVER (PARTITION BY search_brand, meta_ad_id) AS n FROM ({SQL_VERSIONS})) WHERE n > 1""")
def delivery_versions(spark, d):
    _, _, delivery = reconcile.reconcile(versions(spark, d))
    return delivery.select("search_brand", "meta_ad_id", "query_date_min", "collection_timestamp", "de_male")


SQL_BACK = ", ".join(f"{c} DESC" for c in LINE_ORDER)


@query(f"SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY (l_suppkey % 3 != 0) DESC, {SQL_BACK}) = 1")
def latest_with_stop(spark, d):
    return reconcile.latest(t(spark, d, "lineitem"), KEY, [F.desc(c) for c in LINE_ORDER], C("l_suppkey") % 3 != 0).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("SELECT l_orderkey, CAST(count(DISTINCT l_returnflag) AS BIGINT) AS l_returnflag, CAST(count(DISTINCT l_linestatus) AS BIGINT) AS l_linestatus FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1 OR count(DISTINCT l_linestatus) > 1")
def inconsistent_groups(spark, d):
    return checks.inconsistent(t(spark, d, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@query("""SELECT 'n_rows' AS metric, CAST(count(*) AS DOUBLE) AS value, 1500.0::DOUBLE AS expected, count(*) = 1500 AS ok FROM orders UNION ALL SELECT 'largest', max(o_totalprice), 1.0::DOUBLE, max(o_totalprice) = 1.0 FROM orders""")
def expected_metrics(spark, d):
    return checks.expectations(t(spark, d, "orders"), {"n_rows": F.count(F.lit(1)), "largest": F.max("o_totalprice")}, {"n_rows": 1500, "largest": 1.0})


@query("""SELECT c_custkey, c_name, 'page ' || c_mktsegment AS page_id FROM customer WHERE c_acctbal >= 1000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (SELECT s_nationkey FROM supplier)""")
def lookup_subset_and_threshold(spark, d):
    rows = t(spark, d, "customer").withColumn("search_brand", C("c_mktsegment"))
    segments = rows.select("search_brand").distinct().select("search_brand", F.lit("home").alias("sector"), F.concat(F.lit("page "), "search_brand").alias("page_id"))
    inside = rows.where((C("c_acctbal") >= 1000) & scalars.factor(C("c_mktsegment"), ["BUILDING", "MACHINERY"]).isNotNull())
    known = inside.join(t(spark, d, "supplier").select(C("s_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi")
    return lock.with_page_id(known, segments).select("c_custkey", "c_name", "page_id")


def sample_sql(key: str, cells: str, per: int, target: int, seed: int, rows: str) -> str:
    order = ", ".join(f"CASE WHEN k <= {per} THEN {c} END NULLS FIRST" for c in cells.split(", "))
    return f"""SELECT {key}, {cells} FROM (SELECT *, row_number() OVER (PARTITION BY {cells} ORDER BY o, {key}) AS k FROM (SELECT *, sha256(concat_ws('|', CAST({key} AS VARCHAR), '{seed}')) AS o FROM ({rows}))) ORDER BY k > {per}, {order}, o, {key} LIMIT {target}"""


SQL_SIGNATURES = "SELECT signature, m.lang AS lang, m.source AS source FROM (SELECT sha256(text) AS signature, min({'lang': lang, 'source': source}) AS m FROM documents GROUP BY ALL)"


@query(sample_sql("signature", "lang, source", 2, 200, 7, SQL_SIGNATURES))
def sample_of_signatures(spark, d):
    rows = t(spark, d, "documents").select(F.sha2("text", 256).alias("signature"), "lang", "source")
    return audit.stratified_sample(rows, "signature", ["lang", "source"], 2, 200, seed=7)


@query(sample_sql("doc_id", "source", 20, 400, 8, "SELECT doc_id, source FROM documents"))
def sample_by_brand(spark, d):
    return audit.stratified_sample(t(spark, d, "documents").select("doc_id", "source"), "doc_id", ["source"], 20, 400, seed=8)


@query("""SELECT r_name AS country, s AS platform_scope, g AS gender, b AS age_band, lo AS age_min, hi AS age_max FROM region, (VALUES ('both'), ('first'), ('second')) a(s), (VALUES ('all'), ('female'), ('male')) c(g), (VALUES ('18-65+', 18, 65), ('18-24', 18, 24), ('25-34', 25, 34), ('35-44', 35, 44), ('45-54', 45, 54), ('55-64', 55, 64), ('65+', 65, 65)) e(b, lo, hi)""")
def audience_requests(spark, d):
    """The requests of each region."""
    grid = pages.request_grid(spark, {"both": ["x", "y"], "first": ["x"], "second": ["y"]}, {"all": None, "female": [2], "male": [1]}, [("18-24", 18, 24), ("25-34", 25, 34), ("35-44", 35, 44), ("45-54", 45, 54), ("55-64", 55, 64), ("65+", 65, 65)])
    return t(spark, d, "region").select(C("r_name").alias("country")).join(F.broadcast(grid), F.lit(True)).select("country", "platform_scope", "gender", "age_band", "age_min", "age_max")


@query("SELECT count(*) AS written, count(*) AS counted, true AS same FROM orders")
def written_rows(spark, d):
    """What was written, against the count that its writer noted beforehand."""
    path, rows = f"{shared_folder(spark)}/noted-{uuid4().hex}", t(spark, d, "orders")
    files.write_json(rows.agg(F.count(F.lit(1)).alias("counted")), f"{path}/note")
    files.write_partitioned(rows, f"{path}/rows", "o_orderpriority")
    note = files.read_json(spark, f"{path}/note", T.StructType().add("counted", T.LongType()))
    return checks.count_matches(spark.read.parquet(f"{path}/rows"), note)
