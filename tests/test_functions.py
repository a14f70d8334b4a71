import unicodedata
from datetime import date

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reachforge.functions import dates, jsonlist, scalars, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("raw", "a", "b", "c"),
    [
        ("Wir SUCHEN (m/w/d)!", "wir suchen (m/w/d)", "wir suchen m w d", "wir suchen (m/w/d)!"),
        ("ﬁn  Straße ½", "fin strasse 1 2", "fin strasse 1 2", "fin strasse 1⁄2"),
        (None, "", "", ""),
        (" \n ", "", "", ""),
    ],
)
def test_normalisers(spark, raw, a, b, c):
    assert [one(spark, raw, f) for f in (text.normalise_a, text.normalise_b, text.normalise_c)] == [a, b, c]


def test_page_names_and_slugs(spark):
    assert one(spark, "Früh-Stück  GmbH.", text.normalise_d) == "früh stück gmbh"
    assert one(spark, " Früh Stück 24! ", text.slug) == "fr_h_st_ck_24"


def test_signature_takes_null_as_blank(spark):
    df = spark.createDataFrame([("p", None, "b"), ("p", "", "b"), ("p", "b", "")], "p string, x string, y string")
    got = [r[0] for r in df.select(text.signature([F.col("p"), F.col("x"), F.col("y")], "␞")).collect()]
    assert got[0] == got[1] != got[2]


@pytest.mark.parametrize(
    ("raw", "keep", "drop", "blank", "strict"),
    [
        ('["a", null, " b "]', ["a", None, " b "], ["a", " b "], ["a", "", " b "], ["a", "b"]),
        ("plain text", ["plain text"], ["plain text"], ["plain text"], None),
        ('"quoted"', ["quoted"], ["quoted"], ["quoted"], None),
        ("[broken", ["[broken"], ["[broken"], ["[broken"], None),
        ("", [], [], [], None),
        (None, [], [], [], None),
        ("null", [], [], [], None),
        ("[]", [], [], [], []),
    ],
)
def test_json_lists(spark, raw, keep, drop, blank, strict):
    assert [one(spark, raw, lambda c: jsonlist.parse(c)), one(spark, raw, lambda c: jsonlist.parse(c, "drop")), one(spark, raw, lambda c: jsonlist.parse(c, "blank")), one(spark, raw, jsonlist.parse_strict)] == [keep, drop, blank, strict]


def test_list_equality(spark):
    df = spark.createDataFrame([('["b", "a"]', '["a"," b"]', True), ('["a","a"]', '["a"]', False), (None, "[]", True)], "a string, b string, same boolean")
    assert df.where(jsonlist.same_list(F.col("a"), F.col("b")) != F.col("same")).count() == 0


@pytest.mark.parametrize(("raw", "want"), [("2024-02-29", date(2024, 2, 29)), ("2024-02-29T23:30:00+0200", date(2024, 2, 29)), ("2023-02-29", None), ("2024-13-01T00:00:00Z", None), ("", None), (None, None), ("soon", None), ("2024-02-29garbage", date(2024, 2, 29))])
def test_dates_keep_the_local_day(spark, raw, want):
    assert one(spark, raw, dates.date_only) == want
    assert one(spark, raw, dates.month) == (want.strftime("%Y-%m") if want else None)


def test_window_classes(spark):
    df = spark.createDataFrame([("2024-01-01", "inside"), ("2024-12-31", "inside"), ("2023-12-31", "before"), ("2025-01-01", "after"), (None, "missing")], "d string, want string")
    assert df.where(dates.window_class(F.col("d").cast("date"), "2024-01-01", "2024-12-31") != F.col("want")).count() == 0


@given(st.dates(date(2000, 1, 1), date(2030, 1, 1)), st.integers(1, 1000))
def test_bisect_covers_the_range(start, days):
    end = date.fromordinal(start.toordinal() + days)
    (a, b), (c, d) = dates.bisect(start, end)
    assert a == start and d == end and b.toordinal() + 1 == c.toordinal() and b.toordinal() - a.toordinal() == days // 2


def test_bisect_refuses_a_day():
    with pytest.raises(ValueError):
        dates.bisect(date(2024, 1, 1), date(2024, 1, 1))


@pytest.mark.parametrize(("raw", "want"), [("12", 12.0), (" 1.5e3 ", 1500.0), ("NaN", None), ("Infinity", None), ("1d", None), ("1e999", None), ("", None), (None, None)])
def test_numbers_are_finite(spark, raw, want):
    assert one(spark, raw, scalars.number) == want


def test_scopes_and_platforms(spark):
    ages = [('["18","65"]', "Broad"), ('["18","64"]', "Narrow"), ('["30","20"]', None), ('["18"]', None), ("x", None), (None, None)]
    assert [one(spark, a, scalars.age_scope) for a, _ in ages] == [w for _, w in ages]
    platforms = [('["facebook","instagram"]', "Both"), ('["instagram"]', "Instagram-only"), ('["facebook"]', "Facebook-only"), ('["facebook","facebook"]', "Other"), ('["messenger"]', "Other"), ("[]", "Other"), ("", None), (None, None)]
    assert [one(spark, a, scalars.platform_category) for a, _ in platforms] == [w for _, w in platforms]


def test_shares_of_missing_and_zero(spark):
    cols = ["de_male", "de_female", "de_unknown", "de_age_18_24", "de_age_25_34", "de_age_35_44", "de_age_45_54", "de_age_55_64", "de_age_65_plus", "de_age_unknown"]
    rows = [(3, 1, 0, 1, 1, 0, 0, 0, 2, None), (0, 0, 2, 0, 0, 0, 0, 0, 0, 5), (None, 4, None, None, 1, 1, 1, 1, 1, 0)]
    got = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in cols)).withColumns(scalars.share_columns()).collect()
    assert [(r.female_delivery_share, r.adult_18_34_share, r.gender_data_usable, r.age_data_usable, r.has_unknown_gender, r.has_unknown_age) for r in got] == [(0.25, 0.5, 1, 1, 0, None), (None, None, 0, 0, 1, 1), (None, None, 0, 0, None, 0)]


def test_scores(spark):
    got = spark.createDataFrame([("acme shop", 700), ("acme", 10), ("acme jobs", 10), ("other", 0)], "n string, c long")
    s = {r.n: r.s for r in got.select("n", scalars.candidate_score(F.col("n"), F.col("c"), ["acme", "acme shop"], ["jobs"]).alias("s")).collect()}
    assert s == {"acme shop": 1000 + 250 + 150 + 250 + 150 + 0.5, "acme": 1000 + 250 + 150 + 0.01, "acme jobs": -10000.0, "other": 0.0}


def test_half_even_midpoint(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (None, 3)], "a long, b long")
    assert [r[0] for r in df.select(scalars.midpoint(F.col("a"), F.col("b"))).collect()] == [2, 2, None]


@given(st.text(max_size=40))
def test_rule_terms_are_normalised_alike(s):
    folded = unicodedata.normalize("NFKC", s).casefold()
    assert set(text.python_normalise_a(s)) <= set(folded) | {" "}


def test_dates_as_the_standard_library_reads_them(spark):
    from datetime import datetime

    def want(text):
        try:
            return datetime.fromisoformat(text.strip().replace("Z", "+00:00")).date()
        except ValueError:
            try:
                return datetime.strptime(text.strip()[:10], "%Y-%m-%d").date()
            except ValueError:
                return None

    raw = ["2024-W03-1", "2024-W03", "2024W031", "2024W03", " 2020-W53-7 ", "2021-W53-1", "2024-W00-1", "2024-W01-8", "2026-W01-1", "2024-W03-1T10:00Z", "2024-W03-1 10:00:00.5+01:00", "2024-W03-1 junk", "20240115", "20240115T101500", "20240115 junk", "20241315", "2024-01-15junk", "2024-01-15T25:00"]
    raw += [f"{y}-W{w:02}-{d}" for y in (1999, 2004, 2009, 2015, 2016, 2020, 2032) for w in (1, 2, 52, 53) for d in (1, 4, 7)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string").select("i", dates.date_only(F.col("x")).alias("d"))
    assert {raw[r.i]: r.d for r in df.collect()} == {x: want(x) for x in raw}
