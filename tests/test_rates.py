"""Sources under a shared rate limit, planned ranges, keyword search and audience estimates, against a server in this process and recorded replies."""

import json
import threading
import time
from datetime import date
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from reachforge.sources import audience, pages, requests, search
from reachforge.sources.requests import Control, Pace, Reply


@pytest.fixture()
def server():
    """answer(params) gives (status, body); asked: (time, params) of every request."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            params = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            with self.server.lock:
                self.server.asked.append((time.monotonic(), params))
                status, body = self.server.answer(params)
            raw = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.asked, s.lock, s.answer = [], threading.Lock(), lambda p: (200, {"data": []})
    s.url = f"http://127.0.0.1:{s.server_port}/x"
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def test_pace_keeps_requests_apart_also_after_a_restart():
    now, slept = [100.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    p = Pace(2.0, lambda: now[0], sleep)
    p.wait()
    p.wait()
    now[0] += 5
    p.wait()
    p.wait()
    assert slept == [2.0, 2.0, 2.0] and now[0] == 111.0


def test_lanes_share_the_rate():
    assert requests.lanes([1, 2, 3], None, 2) == [([1], 0.0), ([2], 0.0), ([3], 0.0)]
    assert requests.lanes([1, 2, 3, 4, 5], 10.0, 2) == [([1, 3, 5], 0.2), ([2, 4], 0.2)]
    assert requests.lanes([1], 10.0, 4) == [([1], 0.1)] and requests.lanes([], 10.0, 4) == []


def test_four_tasks_keep_one_servers_limit(spark, server):
    rate = 20
    rows = pages.read_ads(spark, [("b", "s", str(k)) for k in range(12)], "2024-01-01", "2024-01-05", days=2, url=server.url, token_env="PATH", rate=rate, lanes=4, page_delay=0)
    assert rows.rdd.getNumPartitions() == 4
    assert rows.collect() == [] and len(server.asked) == 36
    times = sorted(t for t, _ in server.asked)
    for i, start in enumerate(times):
        within = sum(t < start + 0.5 for t in times[i:])
        assert within <= rate * 0.5 + 4 + 1
    assert times[-1] - times[0] >= (36 - 8) / rate


def hot(limit_days):
    """A server that refuses ranges of more days, and has an ad on every day."""

    def answer(p):
        a, b = date.fromisoformat(p["date_min"]), date.fromisoformat(p["date_max"])
        if (b - a).days + 1 > limit_days:
            return 500, {"error": {"message": "Please reduce the amount of data"}}
        return 200, {"data": [{"id": f"{p['page_id']}-{(a.toordinal() + k)}", "ad_delivery_start_time": a.isoformat()} for k in range((b - a).days + 1)]}

    return answer


def test_segments_of_a_hot_page_are_planned_and_read_by_many_tasks(spark, server):
    server.answer = hot(2)
    plan = pages.plan_ranges(spark, [("b", "s", "7")], "2024-01-01", "2024-05-07", days=200, url=server.url, token_env="PATH")
    assert len(plan) == 64 and plan[0].start == "2024-01-01" and plan[-1].end == "2024-05-07"
    assert all((date.fromisoformat(r.end) - date.fromisoformat(r.start)).days <= 1 for r in plan)
    assert [r.start for r in plan[1:]] == [(date.fromordinal(date.fromisoformat(r.end).toordinal() + 1)).isoformat() for r in plan[:-1]]
    asked = len(server.asked)
    rows = pages.read_ads(spark, [], "", "", ranges=json.dumps(plan), url=server.url, token_env="PATH", page_delay=0, rate=400, lanes=4)
    found = rows.withColumn("task", F.spark_partition_id()).collect()
    assert len(found) == len({r.meta_ad_id for r in found}) == 128 and len({r["task"] for r in found}) == 4
    assert len(server.asked) - asked == 64  # none refused any more


def test_planned_collection_resumes(spark, server, tmp_path):
    server.answer = hot(4)
    kw = {"batch": 1, "planned": True, "days": 40, "url": server.url, "token_env": "PATH", "page_delay": 0}
    one = pages.collect_ads(spark, str(tmp_path / "a"), [("b", "s", "1"), ("c", "s", "2")], "2024-01-01", "2024-01-31", **kw)
    assert one.count() == 62 and one.select("meta_ad_id").distinct().count() == 62
    asked = len(server.asked)
    again = pages.collect_ads(spark, str(tmp_path / "a"), [("b", "s", "1"), ("c", "s", "2"), ("d", "s", "3")], "2024-01-01", "2024-01-31", **kw)
    assert again.count() == 93
    read = [p for _, p in server.asked[asked:] if p["page_id"] != "3" and p["limit"] == "250"]
    assert read == []


def test_single_day_that_stays_too_large_is_an_error(spark, server):
    server.answer = hot(0)
    plan = pages.plan_ranges(spark, [("b", "s", "7")], "2024-01-01", "2024-01-03", url=server.url, token_env="PATH")
    assert len(plan) == 3
    with pytest.raises(Exception, match="TooMuchData"):
        pages.read_ads(spark, [], "", "", ranges=json.dumps(plan), url=server.url, token_env="PATH", page_delay=0).collect()


def ads(*pairs):
    return [{"page_id": p, "page_name": n} for p, n in pairs]


def test_keyword_search_tallies_pages_over_terms(spark, tmp_path):
    found = {"alpha": ads(("1", "Old"), ("2", "Two "), ("1", "Old"), ("", "none"), (None, "none")), "beta": ads((" 1 ", "New"), ("3", None)), "gamma": []}
    (tmp_path / "part-0").write_text("\n".join(json.dumps({"term": t, "at": k, "ad": a}) for t, xs in reversed(found.items()) for k, a in enumerate(xs)))
    hits = search.search_pages(spark, [("x", "alpha"), ("x", "beta"), ("y", "beta"), ("y", "gamma")], dir=str(tmp_path), limit=2, page_delay=0)
    assert hits.rdd.getNumPartitions() == 4
    got = {(r.search_brand, r.page_id): (r.page_name, r.ad_count) for r in search.candidates(hits).collect()}
    assert got == {("x", "1"): ("New", 3), ("x", "2"): ("Two", 1), ("x", "3"): ("", 1), ("y", "1"): ("New", 1), ("y", "3"): ("", 1)}
    few = search.search_pages(spark, [("x", "alpha")], dir=str(tmp_path), limit=1, most=2, page_delay=0)
    assert few.count() == 2


def test_search_waits_for_limits_and_refuses_errors():
    slept, replies = [], [Reply(429, {}, {}), Reply(200, {"data": [1], "paging": {"next": "c"}}, {}), Reply(200, {"data": [2]}, {})]
    c = Control(page_delay=0.5)
    assert list(search.found(lambda p: replies.pop(0), {}, 10, 9, c, slept.append)) == [1, 2] and slept == [300.0, 0.5]
    with pytest.raises(RuntimeError, match="400"):
        list(search.found(lambda p: Reply(400, {"error": {"message": "no"}}, {}), {}, 10, 9, c, slept.append))


GRID = ({"both": ["x", "y"], "first": ["x"], "second": ["y"]}, {"all": None, "male": [1], "female": [2]}, [("18-24", 18, 24), ("25-34", 25, 34), ("35-44", 35, 44), ("45-54", 45, 54), ("55-64", 55, 64), ("65+", 65, 65)])


def test_audience_grid_is_collected_with_a_resume_for_each_request(spark, server, tmp_path):
    grid = pages.request_grid(spark, *GRID)

    def answer(p):
        spec = json.loads(p["targeting_spec"])
        if spec["age_max"] == 64 and not server.open:
            return 400, {"error": {"code": 100, "message": "not yet"}}
        if spec["age_min"] == 65:
            return 200, {"data": []}
        low = 100 * spec["age_min"] + len(spec["publisher_platforms"])
        return 200, {"data": [{"estimate_mau_lower_bound": low, "estimate_mau_upper_bound": low + sum(spec.get("genders", [5]))}]}

    server.answer, server.open = answer, False
    path = str(tmp_path / "a")
    with pytest.raises(Exception, match="not yet"):
        audience.collect_estimates(spark, path, grid, batch=7, url=server.url, token_env="PATH", version="v1")
    have = spark.read.parquet(f"{path}/estimates").count()
    time.sleep(0.5)  # for tasks that are still under way
    first, server.open = len(server.asked), True
    got = audience.collect_estimates(spark, path, grid, batch=20, url=server.url, token_env="PATH", version="v1")
    assert got.count() == 63 == got.select(*audience.KEY).distinct().count()
    assert have == 14 and len(server.asked) - first == 63 - have  # what was written before the error was not asked for again
    r = {(x.platform_scope, x.gender, x.age_band): x for x in got.collect()}
    x = r["both", "female", "25-34"]
    assert (x.estimate_mau_lower_bound, x.estimate_mau_upper_bound, x.estimate_mau_midpoint, x.api_version, x.country) == (2502, 2504, 2503, "v1", "DE")
    assert r["first", "male", "18-65+"].estimate_mau_midpoint == 1802 and r["both", "all", "65+"].estimate_mau_midpoint is None  # 1801.5 to even
    assert audience.collect_estimates(spark, path, grid, url="nowhere", token_env="PATH").count() == 63


def test_estimates_wait_and_give_up():
    slept, params = [], audience.targeting({"age_min": 18, "age_max": 65, "platforms": ["x"], "gender_values": None}, "DE")
    assert "genders" not in params["targeting_spec"]
    replies = [Reply(503, {}, {}), Reply(400, {"error": {"code": 17}}, {}), Reply(200, {"data": [1]}, {})]
    assert audience.estimate(lambda p: replies.pop(0), params, slept.append) == {"data": [1]} and slept == [2.0, 4.0]
    with pytest.raises(RuntimeError, match="busy"):
        audience.estimate(lambda p: Reply(429, {}, {}), params, slept.append)
    assert slept[2:] == [2.0, 4.0, 8.0, 16.0, 32.0]
