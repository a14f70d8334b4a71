import pytest
from pyspark.sql import functions as F

from reachforge import schemas as S
from reachforge.operators import audit, benchmarks, checks, configurations, eligibility_rules, lock, profile, reconcile, rules, signatures


def raw(spark, rows):
    """Raw ad rows from dicts; columns that are not named are blank."""
    names = [*S.RAW, "_query_date_min", "_query_date_max", "_seq"]
    data = [tuple(r.get(n, 0 if n == "_seq" else "") for n in names) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"{n} {'long' if n == '_seq' else 'string'}" for n in names))


BASE = {"search_brand": "b", "sector": "home", "target_gender": "All", "publisher_platforms": '["instagram"]', "_query_date_min": "2024-01-01", "_query_date_max": "2024-01-31"}


def test_reconcile_latest_parts_and_conflicts(spark):
    rows = [
        BASE | {"meta_ad_id": "1", "collection_timestamp": "t1", "de_male": "5", "ad_delivery_stop_date_time": "2024-02-01", "publisher_platforms": '["facebook"]'},
        BASE | {"meta_ad_id": "1", "collection_timestamp": "t2", "target_gender": "Women", "_seq": 1},
        BASE | {"meta_ad_id": "1", "collection_timestamp": "t2", "target_gender": "Men", "_query_date_min": "2024-02-01", "_seq": 2},
        BASE | {"meta_ad_id": "2", "collection_timestamp": "t1", "publisher_platforms": '["z","a"]'},
    ]
    final, conflicts, delivery = reconcile.reconcile(raw(spark, rows))
    got = {r.meta_ad_id: r for r in final.collect()}
    assert final.columns == S.RAW and len(got) == 2
    # of equal timestamps the first segment's row counts; reach and stop come from the latest version that has them
    assert (got["1"].target_gender, got["1"].de_male, got["1"].ad_delivery_stop_date_time, got["1"].publisher_platforms) == ("Women", "5", "2024-02-01", '["facebook","instagram"]')
    assert got["2"].publisher_platforms == '["z","a"]'
    c = [(r.differing_field, r.earlier_value, r.later_value) for r in conflicts.orderBy("later_value").collect()]
    assert c == [("target_gender", "Women", "Men"), ("target_gender", "All", "Women")] and conflicts.columns == S.CONFLICT
    assert delivery.count() == 3 and delivery.columns == S.DELIVERY


def test_reconcile_is_idempotent_on_single_versions(spark):
    rows = raw(spark, [BASE | {"meta_ad_id": str(i), "collection_timestamp": "t"} for i in range(5)])
    final, conflicts, delivery = reconcile.reconcile(rows)
    assert checks.same_rows(final, rows.select(*S.RAW)) and conflicts.isEmpty() and delivery.isEmpty()


def cascade(spark, texts):
    df = spark.createDataFrame([(i, [t], ["x"]) for i, t in enumerate(texts)], "i int, body array<string>, title array<string>")
    out = rules.classify(df, ["body", "title"], eligibility_rules.SIGNALS, eligibility_rules.RULES, eligibility_rules.DEFAULT, eligibility_rules.EMPTY)
    return [(r.commercial_eligibility, r.matched_rule, r.matched_field, r.matched_text) for r in out.orderBy("i").collect()]


def test_rule_order_fields_and_terms(spark):
    got = cascade(spark, ["Deine KARRIERE bei uns", "Verkäufer (m/w/d)", "Bewerbung im Team", "Bewerbung", "Stipendium", "Stipendium mit Rabatt", "Jahresbericht", "Produktrückruf", "Datenschutzhinweis", "Spenden", "Recycling", "Hauptsponsor", "Initiative", "Vorstand", "Neue Schuhe", "we're hiring"])
    assert got[0] == ("exclude_clear_noncommercial", "strong_recruitment_phrase", "body", "karriere")
    assert got[1][1:3] == ("explicit_recruitment_gender_marker", "body")
    assert got[2] == ("exclude_clear_noncommercial", "application_plus_employment_context", "combined_text", "bewerbung + team")
    assert [g[1] for g in got[3:]] == ["application_language_without_clear_employment_context", "clear_noncommercial_programme", "programme_plus_commercial_signal", "clear_corporate_report", "safety_or_recall_signal", "clear_legal_or_compliance_notice", "csr_or_charity_signal", "sustainability_signal", "sponsorship_signal", "community_or_initiative_signal", "institutional_context_signal", "no_high_confidence_noncommercial_rule_triggered", "strong_recruitment_phrase"]


def test_phrases_straddle_fields_and_sit_inside_words(spark):
    df = spark.createDataFrame([(["join our"], ["team"]), (["Superrabattaktion Förderpreis"], []), ([], [])], "a array<string>, b array<string>")
    got = rules.classify(df, ["a", "b"], eligibility_rules.SIGNALS, eligibility_rules.RULES, eligibility_rules.DEFAULT, eligibility_rules.EMPTY).collect()
    assert (got[0].matched_rule, got[0].matched_field) == ("strong_recruitment_phrase", "combined_text")
    assert got[1].matched_text == "förderpreis + rabatt" and got[2].matched_rule == "no_creative_text_available"
    kept, review, out = rules.route(spark.createDataFrame(got, "a array<string>, b array<string>, commercial_eligibility string, eligibility_reason string, matched_rule string, matched_field string, matched_text string"))
    assert (kept.count(), review.count(), out.count()) == (2, 2, 1)


def test_lock_and_ledger(spark):
    rows = spark.createDataFrame([(str(i), "b", "home", "r", "m") for i in range(6)], "meta_ad_id string, search_brand string, sector string, eligibility_reason string, matched_rule string")
    auto = rows.where("meta_ad_id < '2'")
    manual = lock.noncommercial(spark.createDataFrame([("3", "commercial", "", 0), ("3", " NonCommercial ", "x", 1), ("4", "noncommercial", "y", 0), ("4", "keep", "", 2)], "meta_ad_id string, final_classification string, final_manual_category string, _seq long"))
    lock.verify(rows, auto, manual)
    assert sorted(r[0] for r in lock.lock(rows, auto, manual).select("meta_ad_id").collect()) == ["2", "4", "5"]
    assert sorted((r.meta_ad_id, r.exclusion_stage, r.manual_category) for r in lock.ledger(rows, auto, manual).collect()) == [("0", "automatic", ""), ("1", "automatic", ""), ("3", "manual", "x")]
    with pytest.raises(ValueError):
        lock.verify(rows, auto, auto)


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, v string")
    for f in (lambda: checks.assert_unique(df, "k"), lambda: checks.assert_unique(df, "v"), lambda: checks.expect_count(df, 2), lambda: checks.assert_schema(df, ["v", "k"]), lambda: checks.require_columns(df, ["z"]), lambda: checks.assert_constant_in_group(df, ["k"], ["v"]), lambda: checks.assert_none(df, F.col("v").isNull(), "no v")):
        with pytest.raises(ValueError):
            f()
    assert not checks.same_rows(df, df.union(df.limit(1))) and checks.same_rows(df, df)
    r = checks.expectations(df, {"n": F.count(F.lit(1)), "v": F.count("v")}, {"n": 3, "v": 3}).collect()
    assert [(x.metric, x.ok) for x in r] == [("n", True), ("v", False)]


def test_collapse_nulls_and_summary(spark):
    df = spark.createDataFrame([("k", "x", "1", None, 1), ("k", "x", "2", None, 2), ("k", "x", "2", None, 3), ("l", "y", "3", 4, None)], "k string, c string, id string, a long, b long")
    out = configurations.collapse(df, ["k"], ["c"], ["a", "b"], "id")
    assert sorted(map(tuple, out.collect())) == [("k", "x", 2, None, 6), ("l", "y", 1, 4, None)]
    assert tuple(configurations.collapse_summary(out).first()) == (2, 1, 1, 2, 2, 1)


def test_signature_conflicts_count_blank_as_a_value(spark):
    df = spark.createDataFrame([("s", "a", None), ("s", "a", "x"), ("t", "a", "x"), ("t", "b", "y"), ("u", "a", "a")], "s string, f string, g string")
    got = {r.s: (r.signature_group_size, r.conflict_fields) for r in signatures.conflicts(df, "s", {"f": F.col("f"), "g": F.col("g")}).collect()}
    assert got == {"s": (2, "g"), "t": (2, "f|g")}


def test_sample_takes_the_minimum_of_each_cell(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 3, "rare").otherwise("common").alias("c"))
    got = audit.stratified_sample(df, "id", ["c"], 2, 50, seed=1)
    n = {r.c: r["count"] for r in got.groupBy("c").count().collect()}
    assert n["rare"] >= 2 and sum(n.values()) == 50
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in audit.stratified_sample(df.repartition(7), "id", ["c"], 2, 50, seed=1).collect())
    assert got.select("id").exceptAll(audit.stratified_sample(df, "id", ["c"], 2, 50, seed=2).select("id")).count() > 0


def test_validity_and_audit_profile(spark):
    df = spark.createDataFrame([("1",), ("-2",), ("1.5",), ("x",), ("",), (None,), ("NaN",)], "v string")
    assert tuple(profile.validity(df, ["v"]).first()) == ("v", 2, 2, 1, 1)
    c = spark.createDataFrame([("creative", "f", "1"), ("creative", "", "1"), ("", "g", "2")], "difference_tier string, differing_field string, meta_ad_id string")
    assert sorted((r.kind, r.label, r.n) for r in profile.audit_profile(c).collect()) == [("difference_tier", "creative", 2), ("differing_field", "f", 1), ("differing_field", "g", 1), ("total", "conflict_ids", 2), ("total", "conflict_rows", 3)]


def test_published_benchmark_bounds(spark):
    rows = [("both", "male", 17_700_000, 20_800_000), ("both", "female", 18_600_000, 21_800_000)]
    r = benchmarks.share_bounds(spark.createDataFrame(rows, "platform_scope string, gender string, estimate_mau_lower_bound long, estimate_mau_upper_bound long")).first()
    assert (round(r.benchmark_lower, 5), round(r.benchmark_upper, 5)) == (0.47208, 0.5519)


def test_an_excluded_id_without_a_row_is_an_error(spark):
    rows = spark.createDataFrame([("1", "b", "home")], "meta_ad_id string, search_brand string, sector string")
    auto = spark.createDataFrame([("2", "r", "m")], "meta_ad_id string, eligibility_reason string, matched_rule string")
    manual = spark.createDataFrame([], "meta_ad_id string, final_manual_category string")
    with pytest.raises(Exception, match="excluded id without a row: 2"):
        lock.ledger(rows, auto, manual).collect()
    with pytest.raises(ValueError, match="_seq"):
        lock.noncommercial(spark.createDataFrame([("1", "keep")], "meta_ad_id string, final_classification string"))


def test_a_sample_holds_an_id_once(spark):
    df = spark.createDataFrame([(i % 30, c) for i, c in zip(range(90), "ab" * 45, strict=True)], "id int, c string")
    got = [r.id for r in audit.stratified_sample(df, "id", ["c"], 2, 50).collect()]
    assert len(got) == len(set(got)) == 30
