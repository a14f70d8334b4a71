import json
from datetime import date
from zipfile import ZipFile

import pytest
from pyspark.sql import functions as F

from reachforge import schemas as S
from reachforge.plans import pipelines
from reachforge.sources import files, pages, requests, resultbook
from reachforge.sources.requests import Control, Reply
from reachforge.streaming.upsert import current, upsert_latest


def test_csv_round_trip(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿a,b\n"x ""y""\nz",1\n,2\n', encoding="utf-8")
    df = files.read_csv(spark, str(p), ["a", "b"])
    assert sorted(map(tuple, df.collect()), key=str) == sorted([('x "y"\nz', "1"), (None, "2")], key=str)
    files.write_csv(df.withColumn("extra", F.lit(1)), str(tmp_path / "out"), ["b", "a"])
    assert files.read_csv(spark, str(tmp_path / "out"), ["b", "a"]).count() == 2
    with pytest.raises(ValueError):
        files.read_csv(spark, str(p), ["a", "b"], ["a", "c"])
    back = files.write_verified(df, str(tmp_path / "t"))
    assert back.count() == 2


def test_typed_csv(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "a.csv").write_text("a,b\n1,NA\nx,2.5\n")
    df = files.read_typed_csv(spark, str(tmp_path / "a.csv"), T.StructType().add("a", T.LongType()).add("b", T.DoubleType()))
    assert sorted(map(tuple, df.collect()), key=str) == [(1, None), (None, 2.5)]


def test_pages_shrink_then_split_and_waits():
    slept, asked = [], []

    def send(p):
        asked.append((p["date_min"], p["date_max"], p["limit"]))
        if len(asked) == 1:
            raise ConnectionError
        if len(asked) == 2:
            return Reply(400, {"error": {"code": 4}}, {"Retry-After": "45"})
        if p["date_min"] != p["date_max"]:
            return Reply(500, {}, {})
        return Reply(200, {"data": [p["date_min"]]}, {})

    got = list(requests.collect_range(send, {}, date(2024, 1, 1), date(2024, 1, 3), Control(), slept.append))
    assert [x for _, _, x in got] == ["2024-01-01", "2024-01-02", "2024-01-03"] and slept == [60.0, 45.0]
    assert {s for a, b, s in asked if a != b} == {250, 100, 50, 25}
    with pytest.raises(requests.TooMuchData):
        list(requests.collect_range(lambda p: Reply(500, {}, {}), {}, date(2024, 1, 1), date(2024, 1, 1), Control(), slept.append))


def test_waits_and_choices():
    c = Control()
    assert [requests.network_wait(n, c) for n in (1, 9)] == [60, 300] and [requests.rate_wait(n, {}, c) for n in (1, 9)] == [300, 1800]
    assert requests.rate_wait(1, {"retry-after": "5"}, c) == 30 and [requests.doubling_wait(n, 5, 120) for n in (1, 2, 9)] == [5, 10, 120]
    assert requests.choose(["A", "b"], " B ,a") == ["A", "b"]
    with pytest.raises(ValueError):
        requests.choose(["A"], "z")
    mark = requests.refuse_changed(None, {"a": 1})
    with pytest.raises(ValueError):
        requests.refuse_changed({"settings": mark}, {"a": 2})


def item(i, day, breakdown=None):
    return {"id": str(i), "ad_creative_bodies": ["Hallo <b>"], "publisher_platforms": ["facebook"], "target_ages": ["18", "65"], "target_gender": "All", "ad_delivery_start_time": day, "age_country_gender_reach_breakdown": breakdown}


def test_paged_source_to_configurations(spark, tmp_path):
    de = {"country": "DE", "age_gender_breakdowns": [{"age_range": "18-24", "male": 1, "female": 3}, {"age_range": "Unknown", "female": 2, "unknown": 1}]}
    (tmp_path / "7").mkdir()
    (tmp_path / "7" / "0.json").write_text(json.dumps({"data": [item(1, "2024-01-05", [de]), item(2, "2024-03-01", [{"country": "FR", "age_gender_breakdowns": []}]), item(3, "2025-01-01")]}))
    raw = pages.read_ads(spark, [("b", "home", "7")], "2024-01-01", "2024-12-31", dir=tmp_path, days=40, page_delay=0)
    got = {r.meta_ad_id: r for r in raw.collect()}
    assert set(got) == {"1", "2"} and (got["1"].de_male, got["1"].de_female, got["1"].de_unknown, got["1"].de_age_18_24, got["1"].de_age_unknown, got["1"].de_age_25_34, got["2"].de_male) == ("1", "5", "1", "4", "3", "0", "")
    assert raw.rdd.getNumPartitions() == 10
    final, _, _ = pipelines.consolidate(raw)
    e = pipelines.classify_and_lock(final, "2024-01-01", "2024-02-01", spark.createDataFrame([], "meta_ad_id string, final_classification string, final_manual_category string, _seq long"))
    assert e.classified.columns == S.CLASSIFIED and e.locked.count() == 1
    retailers = spark.createDataFrame([("b", "home", "7")], S.RETAILERS)
    ready = pipelines.analysis_ready(e.locked, retailers)
    r = ready.first()
    assert ready.columns == [*S.RAW, *S.DERIVED] and (r.female_delivery_share, r.age_scope, r.platform_category, r.month, len(r.creative_signature_hash)) == (5 / 6, "Broad", "Facebook-only", "2024-01", 64)
    assert pipelines.configuration_level(e.locked, retailers).first().configuration_ad_id_count == 1
    with pytest.raises(Exception, match="unknown retailer"):
        pipelines.fingerprint(e.locked, retailers.where("false")).collect()


@pytest.mark.parametrize(("breakdown", "message"), [([{"country": "DE", "age_gender_breakdowns": []}] * 2, "more than one"), ([{"country": "DE", "age_gender_breakdowns": [{"age_range": "1-2"}]}], "unknown age"), ([{"country": "DE", "age_gender_breakdowns": [{"age_range": "65+"}] * 2}], "repeated age")])
def test_bad_breakdowns_are_errors(spark, breakdown, message):
    p = spark.createDataFrame([("b", "home", json.dumps(item(1, "2024-01-01", breakdown)), "", "", 0, "t")], "search_brand string, sector string, payload string, query_date_min string, query_date_max string, seq long, collection_timestamp string")
    with pytest.raises(Exception, match=message):
        pages.to_raw(p).collect()


def test_request_grid(spark):
    grid = pages.request_grid(spark, {"a": ["x"], "b": ["y"], "c": ["x", "y"]}, {"all": None, "male": [1], "female": [2]}, [(f"{i}", i, i) for i in range(6)])
    assert grid.count() == 63


def test_result_book(spark, tmp_path):
    book = resultbook.ResultBook()
    book.put("H1", "Title <1>", ["a", "b"], [{"a": 1.5, "b": "x"}, {"a": None, "b": "y"}])
    book.put_frame("H1", "Second", spark.range(2))
    book.save(str(tmp_path / "r.xlsx"))
    with ZipFile(tmp_path / "r.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert "Title &lt;1&gt;" in sheet and sheet.count("<row ") == 9
    assert "n      1,000" in resultbook.text_report("T", [("n", 1000), ("share", 0.5)])


def test_streaming_upsert(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for k, rows in enumerate([[("1", "t1", "a"), ("2", "t1", "b")], [("1", "t2", "c"), ("3", "t1", "d")], [("1", "t0", "late")]]):
        spark.createDataFrame(rows, "id string, ts string, v string").coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema("id string, ts string, v string").parquet(src)
        upsert_latest(s, out, str(tmp_path / "cp"), ["id"], ["ts"], buckets=4).awaitTermination(120)
        assert k or current(spark, out).count() == 2
    assert sorted((r.id, r.v) for r in current(spark, out).collect()) == [("1", "c"), ("2", "b"), ("3", "d")]


def test_a_smaller_page_size_begins_anew_where_cursors_carry_their_size():
    """The cursor names the size that it was made with, as a link to the next page does."""
    asked = []

    def send(p):
        size, at = map(int, p["after"].split(":")) if "after" in p else (p["limit"], 0)
        asked.append((size, at))
        if at and size > 50:
            return Reply(500, {}, {})
        return Reply(200, {"data": list(range(at, min(at + size, 120))), "paging": {"next": f"{size}:{at + size}"} if at + size < 120 else {}}, {})

    assert requests.pages(send, {}, Control(page_sizes=(100, 50)), lambda _: None) == list(range(120))
    assert asked == [(100, 0), (100, 100), (50, 0), (50, 50), (50, 100)]


def test_doubling_waits_of_a_fetch():
    slept, left = [], [1, 1, 1]

    def send(_):
        if left:
            left.pop()
            raise ConnectionError
        return Reply(200, {}, {})

    requests.fetch(send, {}, Control(doubling=(2, 60)), slept.append)
    assert slept == [2, 4, 8]


def test_collection_resumes_without_finished_segments(spark, tmp_path):
    for k in ("7", "8"):
        (tmp_path / "in" / k).mkdir(parents=True)
        (tmp_path / "in" / k / "0.json").write_text(json.dumps({"data": [item(f"{k}1", "2024-01-05"), item(f"{k}2", "2024-03-01")]}))
    out, ask = str(tmp_path / "out"), {"dir": tmp_path / "in", "days": 40, "page_delay": 0}
    pages.collect_ads(spark, out, [("b", "home", "7")], "2024-01-01", "2024-03-31", **ask)
    (tmp_path / "in" / "7" / "0.json").unlink()  # finished segments are not asked for again
    both = pages.collect_ads(spark, out, [("b", "home", "7"), ("c", "home", "8")], "2024-01-01", "2024-03-31", batch=1, **ask)
    assert sorted(r.meta_ad_id for r in both.collect()) == ["71", "72", "81", "82"]
    with pytest.raises(ValueError, match="settings differ"):
        pages.collect_ads(spark, out, [("b", "home", "7")], "2024-01-01", "2024-04-30", **ask)
