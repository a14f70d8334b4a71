"""Queries over the driver's tables that apply the engine's operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, jsonlist, scalars, text
from .operators import audit, benchmarks, configurations, eligibility_rules, entities, lock, profile, reconcile, rules, signatures, temporal
from .plans.pipelines import share_model
from .stats import tests
from .stats.design import Formula

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The date window of the temporal queries.
START, END = "1996-01-01", "1999-12-31"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


LINE_ORDER = ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
KEY = ["l_orderkey", "l_linenumber"]


#: Line items that a task joins to their orders and collapses.
LINES_A_TASK = 1_000_000


def lines_with_keys(spark: SparkSession, d: str) -> DataFrame:
    """Line items with whole measures, and the attributes of their orders and parts. They are dealt out by order last, in as many parts as their number asks for, so that an aggregation by attributes with distinct orders needs no other deal and its tasks do not grow with the table."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-t(spark, d, "lineitem").count() // LINES_A_TASK))
    li = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("quantity"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.round(F.col("l_discount") * 100).cast("long").alias("discount"))
    of_parts = li.join(t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey").repartition(parts, "l_orderkey")
    return of_parts.join(t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority").repartition(parts, "l_orderkey"), "l_orderkey")


SQL_LINES = """SELECT l_orderkey, l_partkey, l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
 CAST(round(l_discount * 100) AS BIGINT) AS discount, o_orderpriority, p_brand, p_type FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey"""
CONFIG = ["l_returnflag", "l_linestatus", "o_orderpriority", "p_brand"]
SQL_CONFIG = f"""SELECT l_returnflag, l_linestatus, o_orderpriority, p_brand, min(p_brand) AS brand, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_ids, CAST(sum(quantity) AS BIGINT) AS quantity,
 CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(discount) AS BIGINT) AS discount FROM ({SQL_LINES}) GROUP BY ALL"""


def collapsed(spark: SparkSession, d: str) -> DataFrame:
    rows = lines_with_keys(spark, d).withColumn("brand", F.col("p_brand"))
    return configurations.collapse(rows, CONFIG, ["brand"], ["quantity", "cents", "discount"], "l_orderkey", "n_ids")


@query(f"""SELECT *, round(CAST(quantity AS DOUBLE) / (quantity + discount), 9) AS share, CAST(quantity + discount > 0 AS INTEGER) AS usable, CAST(discount > 0 AS INTEGER) AS has_discount FROM ({SQL_CONFIG})""")
def configuration_collapse(spark, d):
    total = F.col("quantity") + F.col("discount")
    return collapsed(spark, d).withColumns({"share": F.round(scalars.ratio(F.col("quantity"), total), 9), "usable": scalars.usable(total), "has_discount": scalars.unknown_flag(F.col("discount"))})


@query(f"""SELECT count(*) AS configurations, count(*) FILTER (n_ids = 1) AS singletons, count(*) FILTER (n_ids > 1) AS repeated, CAST(sum(CASE WHEN n_ids > 1 THEN n_ids ELSE 0 END) AS BIGINT) AS ids_in_repeated,
 max(n_ids) AS largest, CAST(sum(n_ids - 1) AS BIGINT) AS collapsed FROM ({SQL_CONFIG})""")
def configuration_summary(spark, d):
    return configurations.collapse_summary(collapsed(spark, d), "n_ids")


@query("""SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_ids, count(*) FILTER (n > 1) AS repeated_ids, CAST(sum(n - 1) AS BIGINT) AS extra_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def identity_profile(spark, d):
    return profile.identity_profile(t(spark, d, "lineitem"), *KEY)


@query("""SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN '<all>' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n_rows, count(*) FILTER (o_orderstatus = 'F') AS filled, count(*) FILTER (o_totalprice > 200000) AS large,
 count(*) FILTER (o_orderdate < TIMESTAMP '1996-01-01') AS early FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def conditional_counters(spark, d):
    tests_ = {"filled": F.col("o_orderstatus") == "F", "large": F.col("o_totalprice") > 200000, "early": F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")}
    return profile.counters(t(spark, d, "orders"), tests_, "o_orderpriority")


@query("""SELECT 'value' AS "column", count(*) FILTER (value IS NULL) AS n_blank, CAST(0 AS BIGINT) AS n_invalid, count(*) FILTER (value < 0) AS n_negative, count(*) FILTER (value != floor(value)) AS n_fraction FROM events
 UNION ALL SELECT 'event_type', count(*) FILTER (event_type IS NULL OR trim(event_type) = ''), count(*) FILTER (trim(event_type) != ''), 0, 0 FROM events""")
def count_validity(spark, d):
    e = t(spark, d, "events")
    return profile.validity(e.select(F.col("value").cast("string").alias("value"), "event_type"), ["value", "event_type"])


@query("""SELECT CASE WHEN grouping(l_returnflag) = 1 THEN '<all>' ELSE l_returnflag END AS l_returnflag, count(*) AS n_rows, count(*) FILTER (l_linenumber % 3 = CAST(l_quantity AS BIGINT) % 3) AS matches, count(*) FILTER (l_linenumber % 3 != CAST(l_quantity AS BIGINT) % 3) AS mismatches FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def reconciliation_counts(spark, d):
    return profile.reconciliation(t(spark, d, "lineitem"), F.col("l_linenumber") % 3, F.col("l_quantity").cast("long") % 3, "l_returnflag")


@query("""SELECT 'n_rows' AS metric, CAST(count(*) AS VARCHAR) AS value, 'all' AS note FROM orders UNION ALL SELECT 'filled', CAST(count(*) FILTER (o_orderstatus = 'F') AS VARCHAR), '' FROM orders""")
def metric_table(spark, d):
    return profile.long_form(profile.counters(t(spark, d, "orders"), {"filled": F.col("o_orderstatus") == "F"}), {"n_rows": "all"})


@query("""SELECT 'total' AS kind, '<all>' AS key, o_orderstatus AS label, count(*) AS n FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'o_orderpriority', o_orderpriority, o_orderstatus, count(*) FROM orders GROUP BY ALL""")
def class_counts(spark, d):
    return profile.class_counts(t(spark, d, "orders"), "o_orderstatus", ["o_orderpriority"])


IN_WINDOW = f"o_orderdate >= TIMESTAMP '{START}' AND o_orderdate < TIMESTAMP '2000-01-01'"


@query(f"""SELECT o_orderpriority, count(*) AS n_rows, count(*) FILTER ({IN_WINDOW}) AS included, count(*) FILTER (o_orderdate < TIMESTAMP '{START}') AS excluded_before, count(*) FILTER (o_orderdate >= TIMESTAMP '2000-01-01') AS excluded_after,
 count(*) FILTER (o_orderdate IS NULL) AS excluded_missing, CAST(min(o_orderdate) AS DATE) AS first_date, CAST(max(o_orderdate) AS DATE) AS last_date, round(100.0::DOUBLE * count(*) FILTER ({IN_WINDOW}) / count(*), 4) AS included_percent FROM orders GROUP BY o_orderpriority""")
def window_summary(spark, d):
    return temporal.summary(t(spark, d, "orders"), "o_orderdate", START, END, "o_orderpriority")


@query(f"SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE {IN_WINDOW}")
def temporal_filter(spark, d):
    return temporal.eligible(t(spark, d, "orders"), "o_orderdate", START, END).select("o_orderkey", "o_custkey", "o_orderdate")


SQL_BACK = ", ".join(f"{c} DESC" for c in LINE_ORDER)


def back(names: list[str] = LINE_ORDER):
    return [F.desc(c) for c in names]


@query(f"SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {SQL_BACK}) = 1")
def latest_version(spark, d):
    return reconcile.latest(t(spark, d, "lineitem"), KEY, back())


@query(f"SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY (l_returnflag = 'R') DESC, {SQL_BACK}) = 1")
def latest_flagged_version(spark, d):
    return reconcile.latest(t(spark, d, "lineitem"), KEY, back(), F.col("l_returnflag") == "R")


@query(f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_returnflag AS r, l_linestatus AS s, CAST(l_partkey AS VARCHAR) AS p, lag(l_returnflag) OVER w AS r0, lag(l_linestatus) OVER w AS s0, lag(CAST(l_partkey AS VARCHAR)) OVER w AS p0
 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(LINE_ORDER)}))
 SELECT l_orderkey, l_linenumber, 'creative' AS difference_tier, 'l_returnflag' AS differing_field, r0 AS earlier_value, r AS later_value FROM v WHERE r0 != r
 UNION ALL SELECT l_orderkey, l_linenumber, 'targeting', 'l_linestatus', s0, s FROM v WHERE s0 != s UNION ALL SELECT l_orderkey, l_linenumber, 'start', 'l_partkey', p0, p FROM v WHERE p0 != p""")
def version_conflicts(spark, d):
    return reconcile.changes(t(spark, d, "lineitem"), KEY, [F.col(c) for c in LINE_ORDER], {"l_returnflag": "creative", "l_linestatus": "targeting", "l_partkey": "start"})


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n_versions FROM lineitem GROUP BY ALL HAVING count(DISTINCT (l_quantity, l_tax)) > 1""")
def delivery_drift(spark, d):
    return reconcile.drifted(t(spark, d, "lineitem"), KEY, ["l_quantity", "l_tax"])


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags FROM lineitem GROUP BY l_orderkey")
def list_union(spark, d):
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(reconcile.union_of_lists(F.array("l_returnflag")), ",").alias("flags"))


@query("""SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY ALL""")
def json_fields(spark, d):
    k = F.from_json("props", "k bigint")["k"] % 10
    return t(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, array_to_string(list_sort(['b', o_orderstatus, 'a']), '|') AS items, CAST(3 AS INTEGER) AS n FROM orders""")
def json_lists(spark, d):
    raw = F.concat(F.lit('["b", " '), F.col("o_orderstatus"), F.lit('", null, "a"]'))
    items = jsonlist.multiset(raw)
    return t(spark, d, "orders").select("o_orderkey", F.array_join(items, "|").alias("items"), F.size(items).alias("n"))


SQL_FOLD = "replace(lower(text), 'ß', 'ss')"


def sql_squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


SQL_A = sql_squeeze(f"regexp_replace({SQL_FOLD}, '[^0-9a-zäöüß/()+\\-]+', ' ', 'g')")
SQL_B = sql_squeeze(f"regexp_replace({SQL_FOLD}, '[^0-9a-zäöüß]+', ' ', 'g')")
SQL_C = sql_squeeze(SQL_FOLD)


@query(f"SELECT doc_id, sha256({SQL_A}) AS a, sha256({SQL_B}) AS b, sha256({SQL_C}) AS c FROM documents")
def normalised_text(spark, d):
    one = lambda f: F.sha2(f(F.col("text")), 256)
    return t(spark, d, "documents").select("doc_id", one(text.normalise_a).alias("a"), one(text.normalise_b).alias("b"), one(text.normalise_c).alias("c"))


SQL_SIGNED = f"SELECT doc_id, lang, source, sha256(concat(source, '␞', {SQL_C})) AS signature, sha256(concat(source, chr(31), {SQL_B})) AS audit_signature FROM documents"


def signed(spark, d) -> DataFrame:
    docs = t(spark, d, "documents")
    return docs.select("doc_id", "lang", "source", text.stable_signature(F.col("source"), [F.array("text")]).alias("signature"), text.audit_signature(F.col("source"), [F.col("text")]).alias("audit_signature"))


@query(SQL_SIGNED)
def signatures_of_text(spark, d):
    return signed(spark, d)


SQL_HASHED = "SELECT doc_id, lang, source, sha256(text) AS signature FROM documents"


def hashed(spark, d) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("signature"))


@query(f"""SELECT signature, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source, count(DISTINCT doc_id) AS n_ids, array_to_string(list_sort(list(DISTINCT CAST(doc_id AS VARCHAR))), '|') AS ids FROM ({SQL_HASHED}) GROUP BY signature""")
def signature_collapse(spark, d):
    return signatures.collapse_to_signatures(hashed(spark, d), "signature", "doc_id", [], ["lang", "source"])


@query(f"SELECT n AS group_size, count(*) AS n_signatures FROM (SELECT count(*) AS n FROM ({SQL_HASHED}) GROUP BY signature) GROUP BY n")
def signature_group_sizes(spark, d):
    return signatures.group_sizes(hashed(spark, d), "signature")


CUSTOMER_FIELDS = ["o_orderstatus", "o_orderpriority"]
SQL_CONFLICTS = """SELECT o_custkey, count(*) AS signature_group_size, concat_ws('|', CASE WHEN min(o_orderstatus) != max(o_orderstatus) THEN 'o_orderstatus' END, CASE WHEN min(o_orderpriority) != max(o_orderpriority) THEN 'o_orderpriority' END) AS conflict_fields
 FROM orders GROUP BY o_custkey HAVING min(o_orderstatus) != max(o_orderstatus) OR min(o_orderpriority) != max(o_orderpriority)"""


def customer_conflicts(spark, d) -> DataFrame:
    return signatures.conflicts(t(spark, d, "orders"), "o_custkey", {c: F.col(c) for c in CUSTOMER_FIELDS})


@query(SQL_CONFLICTS)
def structural_conflicts(spark, d):
    return customer_conflicts(spark, d)


@query(f"SELECT 'conflict_pattern' AS summary_type, conflict_fields AS category, count(*) AS n_conflicting_signature_groups FROM ({SQL_CONFLICTS}) GROUP BY conflict_fields UNION ALL SELECT 'brand', c_mktsegment, count(*) FROM ({SQL_CONFLICTS}) JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment")
def conflict_summary(spark, d):
    groups = customer_conflicts(spark, d).join(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return signatures.conflict_summary(groups, "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey) AS signature_group_size FROM lineitem")
def group_size_on_rows(spark, d):
    return signatures.with_group_size(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "signature_group_size")


# Terms of the test corpus in the place of a rule table's.
CORPUS_SIGNALS = {
    "insult": rules.Signal(("idiot", "moron", "scum", "worthless")), "licence": rules.Signal(("licensed under", "mit license")), "public": rules.Signal(("general public license",)),
    "marks": rules.Signal((r"(^|[^a-z0-9])cc by[^a-z]nc",), regex=True), "the": rules.Signal(("the and", "of the")),
}
OUT = "exclude"
CORPUS_RULES = [
    rules.Rule("insult_and_licence", OUT, "conduct", ("insult", "licence")),
    rules.Rule("insult", OUT, "conduct", ("insult",)),
    rules.Rule("cc", "manual_review", "unclear", ("marks",)),
    rules.Rule("licence_and_public", "manual_review", "unclear", ("licence", "public")),
    rules.Rule("licence", OUT, "legal", ("licence",)),
    rules.Rule("frequent", "manual_review", "unclear", ("the",)),
]
KEEP, EMPTY = rules.Rule("none", "retain", "", ()), rules.Rule("empty", "manual_review", "unclear", ())


def rule_sql(signals: dict[str, rules.Signal], table: list[rules.Rule], keep: rules.Rule, empty: rules.Rule) -> str:
    """The rule table as CASE expressions."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def match(s: rules.Signal) -> str:
        test = lambda x: f"regexp_matches(t, {quote(x.replace('(?<![a-z0-9])', '(^|[^a-z0-9])').replace('(?![a-z0-9])', '($|[^a-z0-9])'))})" if s.regex else f"contains(t, {quote(text.python_normalise_a(x))})"
        return "CASE " + " ".join(f"WHEN {test(x)} THEN {quote(x)}" for x in s.terms) + " END"

    used = list(dict.fromkeys(s for r in table for s in r.signals))
    case = lambda pick: f"CASE WHEN t = '' THEN {pick(empty)} " + " ".join(f"WHEN {' AND '.join(f'm_{s} IS NOT NULL' for s in r.signals)} THEN {pick(r)}" for r in table) + f" ELSE {pick(keep)} END"
    field = lambda r: "'text'" if len(r.signals) == 1 else "'combined_text'" if r.signals else "''"
    what = lambda r: " || ' + ' || ".join(f"m_{s}" for s in r.signals) if r.signals else "''"
    return f"""WITH n AS (SELECT doc_id, {SQL_A} AS t FROM documents), m AS (SELECT doc_id, t, {", ".join(f"{match(signals[s])} AS m_{s}" for s in used)} FROM n)
 SELECT doc_id, {case(lambda r: quote(r.verdict))} AS commercial_eligibility, {case(lambda r: quote(r.reason))} AS eligibility_reason, {case(lambda r: quote(r.name))} AS matched_rule, {case(field)} AS matched_field, {case(what)} AS matched_text FROM m"""


SQL_CLASSIFIED = rule_sql(CORPUS_SIGNALS, CORPUS_RULES, KEEP, EMPTY)


def classified(spark, d, extra: tuple[str, ...] = ()) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", *extra, "text")
    return rules.classify(docs, ["text"], CORPUS_SIGNALS, CORPUS_RULES, KEEP, EMPTY).drop("text")


@query(SQL_CLASSIFIED)
def rule_cascade(spark, d):
    return classified(spark, d)


@query(rule_sql(eligibility_rules.SIGNALS, eligibility_rules.RULES, eligibility_rules.DEFAULT, eligibility_rules.EMPTY))
def commercial_eligibility(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text")
    return rules.classify(docs, ["text"], eligibility_rules.SIGNALS, eligibility_rules.RULES, eligibility_rules.DEFAULT, eligibility_rules.EMPTY).drop("text")


SQL_OUT = f"SELECT c.*, source, lang FROM ({SQL_CLASSIFIED}) c JOIN documents USING (doc_id)"
SQL_RATES = f"""SELECT source, count(*) AS n_rows, count(*) FILTER (commercial_eligibility = 'exclude') AS n_excluded FROM ({SQL_OUT}) GROUP BY source"""


@query(f"SELECT *, round(100.0::DOUBLE * n_excluded / n_rows, 4) AS rate_percent, round(100.0::DOUBLE * n_excluded / sum(n_excluded) OVER (), 4) AS share_percent FROM ({SQL_RATES})")
def exclusion_rates(spark, d):
    return audit.exclusion_rates(classified(spark, d, ("source",)), F.col("commercial_eligibility") == "exclude", "source")


@query(f"SELECT 'commercial_eligibility' AS type, commercial_eligibility AS label, count(*) AS count, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS pct FROM ({SQL_CLASSIFIED}) GROUP BY ALL UNION ALL SELECT 'matched_rule', matched_rule, count(*), round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) FROM ({SQL_CLASSIFIED}) GROUP BY ALL")
def classification_summary(spark, d):
    return audit.summary_by(classified(spark, d), ["commercial_eligibility", "matched_rule"])


SQL_BRANDS = "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand"


def brands(spark, d) -> DataFrame:
    return t(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT p_brand, n, row_number() OVER (ORDER BY n DESC, p_brand) AS rank, CAST(sum(n) OVER (ORDER BY n DESC, p_brand ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, round(100.0::DOUBLE * sum(n) OVER (ORDER BY n DESC, p_brand ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 4) AS running_percent FROM ({SQL_BRANDS})""")
def concentration(spark, d):
    return audit.concentration(brands(spark, d), "p_brand", "n")


@query(f"""SELECT round(100.0::DOUBLE * sum(n) FILTER (r <= 1) / sum(n), 4) AS top_1_percent, round(100.0::DOUBLE * sum(n) FILTER (r <= 3) / sum(n), 4) AS top_3_percent, round(100.0::DOUBLE * sum(n) FILTER (r <= 5) / sum(n), 4) AS top_5_percent FROM (SELECT n, row_number() OVER (ORDER BY n DESC, p_brand) AS r FROM ({SQL_BRANDS}))""")
def top_concentration(spark, d):
    return audit.top_share(brands(spark, d), "p_brand", "n")


SQL_SAMPLE = """SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY o, doc_id) AS k FROM (SELECT doc_id, lang, source, sha256(concat_ws('|', CAST(doc_id AS VARCHAR), '7')) AS o FROM documents))
 ORDER BY k > 2, CASE WHEN k <= 2 THEN lang END NULLS FIRST, CASE WHEN k <= 2 THEN source END NULLS FIRST, o, doc_id LIMIT 300"""


def sampled(spark, d) -> DataFrame:
    return audit.stratified_sample(t(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id", ["lang", "source"], 2, 300, seed=7)


@query(SQL_SAMPLE)
def stratified_sample(spark, d):
    return sampled(spark, d)


@query(f"SELECT d.lang, d.source, d.n AS n_rows, coalesce(s.n, 0) AS n_sampled FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) d LEFT JOIN (SELECT lang, source, count(*) AS n FROM ({SQL_SAMPLE}) GROUP BY ALL) s ON s.lang = d.lang AND s.source = d.source")
def sample_coverage(spark, d):
    return audit.coverage(sampled(spark, d), t(spark, d, "documents").select("lang", "source"), ["lang", "source"])


AUTO, MANUAL = "c_acctbal < 0", "c_mktsegment = 'MACHINERY' AND c_acctbal >= 9000"


def ads(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers in the place of ads: balances below zero are excluded by rule, some segments by hand."""
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("meta_ad_id"), F.col("c_mktsegment").alias("search_brand"), F.col("c_nationkey").cast("string").alias("sector"), "c_acctbal", "c_mktsegment", F.lit("recruitment").alias("eligibility_reason"), F.lit("negative").alias("matched_rule"))
    decisions = rows.where(MANUAL).select("meta_ad_id", F.lit(" NonCommercial").alias("final_classification"), F.lit("charity").alias("final_manual_category"), F.col("meta_ad_id").alias("_seq"))
    return rows, rows.where(AUTO), lock.noncommercial(decisions)


@query(f"SELECT c_custkey AS meta_ad_id, c_mktsegment AS search_brand FROM customer WHERE NOT ({AUTO}) AND NOT ({MANUAL})")
def eligibility_lock(spark, d):
    return lock.lock(*ads(spark, d)).select("meta_ad_id", "search_brand")


@query(f"""SELECT c_custkey AS meta_ad_id, c_mktsegment AS search_brand, CAST(c_nationkey AS VARCHAR) AS sector, 'automatic' AS exclusion_stage, 'recruitment' AS exclusion_reason, 'negative' AS exclusion_rule, '' AS manual_category FROM customer WHERE {AUTO}
 UNION ALL SELECT c_custkey, c_mktsegment, CAST(c_nationkey AS VARCHAR), 'manual', 'manual_review', '', 'charity' FROM customer WHERE {MANUAL}""")
def exclusion_ledger(spark, d):
    return lock.ledger(*ads(spark, d))


@query("""SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)
 UNION ALL SELECT 'either', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)""")
def set_relations(spark, d):
    a, b = t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    one = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one(a.intersect(b), "both").unionByName(one(a.subtract(b), "customers only")).unionByName(one(a.union(b).distinct(), "either"))


@query("SELECT s.s_suppkey, s.s_name, n.n_name FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey")
def dimension_lookup(spark, d):
    n = t(spark, d, "nation").select(F.col("n_name"), F.col("n_nationkey").alias("s_nationkey"))
    return t(spark, d, "supplier").join(n, "s_nationkey").select("s_suppkey", "s_name", "n_name")


@query("SELECT *, n / CAST(sum(n) OVER (PARTITION BY c_mktsegment) AS DOUBLE) AS row_share FROM (SELECT c_mktsegment, n_regionkey, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)")
def contingency_table(spark, d):
    return tests.contingency(segments(spark, d), "c_mktsegment", "n_regionkey")


def segments(spark, d) -> DataFrame:
    return t(spark, d, "customer").join(t(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey").select("c_mktsegment", "n_regionkey")


@query("""WITH g AS (SELECT c_mktsegment AS a, n_regionkey AS b, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
 f AS (SELECT x.a, y.b, coalesce(g.n, 0) AS n FROM (SELECT DISTINCT a FROM g) x CROSS JOIN (SELECT DISTINCT b FROM g) y LEFT JOIN g ON g.a = x.a AND g.b = y.b),
 e AS (SELECT *, CAST(sum(n) OVER (PARTITION BY a) AS DOUBLE) * CAST(sum(n) OVER (PARTITION BY b) AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS e FROM f)
 SELECT round(sum((n - e) * (n - e) / e), 6) AS statistic, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df, CAST(sum(n) AS BIGINT) AS n, round(sqrt(sum((n - e) * (n - e) / e) / (sum(n) * (least(count(DISTINCT a), count(DISTINCT b)) - 1))), 6) AS cramers_v, avg(CASE WHEN e < 5 THEN 1.0 ELSE 0.0 END) AS small_share FROM e""")
def chi_square(spark, d):
    return tests.chi_square_columns(segments(spark, d), "c_mktsegment", "n_regionkey").select(F.round("statistic", 6).alias("statistic"), "df", "n", F.round("cramers_v", 6).alias("cramers_v"), "small_share")


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(median(value), 6) AS median, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def descriptives(spark, d):
    r = lambda c: F.round(c, 6).alias(c)
    return tests.describe(t(spark, d, "events"), F.col("value"), ["event_type"]).select("event_type", "n", r("mean"), r("sd"), r("median"), "low", "high")


@query("""SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS q0, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS q100,
 round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM events GROUP BY event_type""")
def quantiles(spark, d):
    q = tests.quantiles(t(spark, d, "events"), F.col("value"), ["event_type"])
    return q.select("event_type", *[F.round(c, 6).alias(c) for c in q.columns[1:]])


@query("SELECT CASE WHEN l_discount = 0 THEN 'Zero' WHEN l_discount = 1 THEN 'One' ELSE 'Interior' END AS boundary, count(*) AS n, median(l_quantity) AS median_quantity FROM lineitem GROUP BY 1")
def boundary_counts(spark, d):
    return t(spark, d, "lineitem").groupBy(scalars.boundary(F.col("l_discount")).alias("boundary")).agg(F.count(F.lit(1)).alias("n"), F.median("l_quantity").alias("median_quantity"))


SQL_BOUNDS = """SELECT p_type AS benchmark_scope, CAST(max(lo) FILTER (g = 'female') AS DOUBLE) / (max(lo) FILTER (g = 'female') + max(hi) FILTER (g = 'male')) AS benchmark_lower, CAST(max(hi) FILTER (g = 'female') AS DOUBLE) / (max(hi) FILTER (g = 'female') + max(lo) FILTER (g = 'male')) AS benchmark_upper
 FROM (SELECT p_type, CASE WHEN p_size % 2 = 0 THEN 'female' ELSE 'male' END AS g, min(p_size) + 10 AS lo, max(p_size) + 10 AS hi FROM part GROUP BY ALL) GROUP BY p_type"""


def part_bounds(spark, d) -> DataFrame:
    g = t(spark, d, "part").groupBy("p_type", F.when(F.col("p_size") % 2 == 0, "female").otherwise("male").alias("gender")).agg((F.min("p_size") + 10).alias("lo"), (F.max("p_size") + 10).alias("hi"))
    return benchmarks.share_bounds(g, "p_type", "gender", "lo", "hi")


@query(f"SELECT benchmark_scope, round(benchmark_lower, 9) AS benchmark_lower, round(benchmark_upper, 9) AS benchmark_upper FROM ({SQL_BOUNDS})")
def benchmark_bounds(spark, d):
    return part_bounds(spark, d).select("benchmark_scope", F.round("benchmark_lower", 9).alias("benchmark_lower"), F.round("benchmark_upper", 9).alias("benchmark_upper"))


@query(f"""SELECT p_brand, round(avg(x) * 100, 6) AS observed_share_percent, round(avg(x - benchmark_lower) * 100, 6) AS signed_gap_lower_pp, round(avg(x - benchmark_upper) * 100, 6) AS signed_gap_upper_pp, round(avg(abs(x - benchmark_lower)) * 100, 6) AS absolute_gap_lower_pp, round(avg(abs(x - benchmark_upper)) * 100, 6) AS absolute_gap_upper_pp
 FROM (SELECT p_brand, p_type, p_size / 50.0::DOUBLE AS x FROM part) JOIN ({SQL_BOUNDS}) ON benchmark_scope = p_type GROUP BY p_brand""")
def benchmark_gaps(spark, d):
    rows = t(spark, d, "part").select("p_brand", "p_type", (F.col("p_size") / 50.0).alias("x"))
    g = benchmarks.gaps(rows, part_bounds(spark, d), F.col("p_type"), "x", "p_brand")
    return g.select("p_brand", *[F.round(c, 6).alias(c) for c in g.columns[1:]])


ACCEPTED, REJECTED = ["red widget", "blue ring"], ["small"]
SQL_SCORES = """SELECT p_name, n, CASE WHEN contains(p_name, 'small') THEN -10000.0 ELSE CASE WHEN p_name IN ('red widget', 'blue ring') THEN 1000.0 ELSE 0.0 END + CASE WHEN contains(p_name, 'red widget') THEN 250.0 ELSE 0.0 END + CASE WHEN list_contains(string_split(p_name, ' '), 'red') AND list_contains(string_split(p_name, ' '), 'widget') THEN 150.0 ELSE 0.0 END
 + CASE WHEN contains(p_name, 'blue ring') THEN 250.0 ELSE 0.0 END + CASE WHEN list_contains(string_split(p_name, ' '), 'blue') AND list_contains(string_split(p_name, ' '), 'ring') THEN 150.0 ELSE 0.0 END + least(n, 500) / 1000.0 END::DOUBLE AS score FROM (SELECT p_name, count(*) AS n FROM part GROUP BY p_name)"""


def scored(spark, d) -> DataFrame:
    names = t(spark, d, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))
    return names.withColumn("score", scalars.candidate_score(F.col("p_name"), F.col("n"), ACCEPTED, REJECTED))


@query(f"SELECT p_name, n, round(score, 6) AS score FROM ({SQL_SCORES})")
def candidate_scores(spark, d):
    return scored(spark, d).select("p_name", "n", F.round("score", 6).alias("score"))


@query(f"""SELECT s.p_name, g, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank, tied > 1 AS ambiguous, best >= 100 AND tied = 1 AND rank = 1 AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, p_name) AS rank, sum(CASE WHEN score = best THEN 1 ELSE 0 END) OVER (PARTITION BY g) AS tied
 FROM (SELECT *, max(score) OVER (PARTITION BY g) AS best FROM (SELECT *, string_split(p_name, ' ')[2] AS g FROM ({SQL_SCORES})))) s WHERE rank <= 3""")
def top_candidates(spark, d):
    s = scored(spark, d).withColumn("g", F.get(F.split("p_name", " "), F.lit(1)))
    return entities.top_candidates(s, "g", "score", ["p_name"], k=3).select("p_name", "g", F.round("score", 6).alias("score"), "rank", "ambiguous", "accepted")


@query("SELECT user_id, count(*) AS ad_count, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def page_tally(spark, d):
    return entities.tally(t(spark, d, "events"), "user_id", "event_type", "event_id")


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS slug, CAST(round_even(CAST(p_size AS DOUBLE) / 2, 0) AS BIGINT) AS midpoint, CASE WHEN p_size % 5 != 0 THEN round(100.0::DOUBLE * 1 / (p_size % 5), 4) ELSE 0.0 END AS percent,
 CASE WHEN p_size = 18 THEN 'Broad' WHEN p_size <= 30 THEN 'Narrow' END AS scope, CASE p_partkey % 5 WHEN 0 THEN 'Both' WHEN 1 THEN 'Facebook-only' WHEN 2 THEN 'Other' WHEN 3 THEN 'Other' END AS platform FROM part""")
def scalar_functions(spark, d):
    c = F.col
    ages = F.concat(F.lit('["'), c("p_size").cast("string"), F.lit('", "'), F.when(c("p_size") == 18, "65").otherwise("30"), F.lit('"]'))
    platforms = F.when(c("p_partkey") % 5 == 0, '["facebook", "instagram"]').when(c("p_partkey") % 5 == 1, '["facebook"]').when(c("p_partkey") % 5 == 2, '["messenger"]').when(c("p_partkey") % 5 == 3, "[]").otherwise("facebook")
    return t(spark, d, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), scalars.midpoint(F.lit(0), c("p_size")).alias("midpoint"), scalars.percent(F.lit(1), c("p_size") % 5).alias("percent"), scalars.age_scope(ages).alias("scope"), scalars.platform_category(platforms).alias("platform"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%Y-%m') AS month, CAST(o_orderdate AS DATE) + CAST(15 AS INTEGER) AS first_end, CAST(o_orderdate AS DATE) + CAST(16 AS INTEGER) AS second_start FROM orders""")
def date_functions(spark, d):
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T23:30:00+0200"))
    day = dates.date_only(iso)
    end, start = dates.bisect_columns(day, F.date_add(day, 31))
    return t(spark, d, "orders").select("o_orderkey", day.alias("day"), dates.month(iso).alias("month"), end.alias("first_end"), start.alias("second_start"))


def line_model(spark, d, terms: tuple[str, ...]):
    """A share model of line items: clusters are brands, factors return flag and line status."""
    li = t(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", (F.col("l_discount") * 10).alias("y"))
    rows = li.join(t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return share_model(rows.where("y <= 1"), F.col("y"), "p_brand", Formula(terms, {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"]}))


@query("SELECT l_returnflag AS level, round(avg(l_discount * 10), 6) AS estimate FROM lineitem WHERE l_discount * 10 <= 1 GROUP BY l_returnflag")
def fractional_logit_means(spark, d):
    """A saturated model's predictions are the group means."""
    rows = line_model(spark, d, ("l_returnflag",)).predictions("l_returnflag")
    return spark.createDataFrame([(r["level"], round(r["estimate"], 6)) for r in rows], "level string, estimate double")


@query()
def fractional_logit_coefficients(spark, d):
    rows = line_model(spark, d, ("l_returnflag", "l_linestatus")).coefficients()
    return spark.createDataFrame([(r["term"], r["estimate"], r["se"], r["t"], r["df"], r["p"]) for r in rows], "term string, estimate double, se double, t double, df double, p double")


@query()
def leave_one_out_contrasts(spark, d):
    rows = line_model(spark, d, ("l_returnflag", "l_linestatus")).leave_one_out("l_returnflag")
    return spark.createDataFrame([(r["name"], r["low"], r["low_without"], r["high"], r["high_without"]) for r in rows], "name string, low double, low_without string, high double, high_without string")


from . import model_queries, source_queries, table_queries  # noqa: E402, F401  they add their own
