"""Audience estimates over a grid of requests as a Spark data source, collected with a resume for each request."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from .pages import Lane, _table, http, rate_of
from .requests import Control, Reply, doubling_wait, lanes, paced

KEY = ["country", "platform_scope", "gender", "age_band"]
SCHEMA = "country string, platform_scope string, gender string, age_band string, age_min int, age_max int, estimate_mau_lower_bound long, estimate_mau_upper_bound long, api_version string, collected_at_utc timestamp, response string"
#: Tries of a request, and the first and longest wait between them; the waits double.
TRIES, WAITS = 5, (2.0, 60.0)
AGAIN = (429, 500, 502, 503, 504)


class AudienceEstimates(DataSource):
    """Options: requests (JSON list of rows of the grid), country, version, rate and lanes (requests a second over all tasks, and tasks that share them), and either dir (recorded replies, see `recorded`) or url with token_env."""

    @classmethod
    def name(cls) -> str:
        return "audience_estimates"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return AudienceReader(self.options)


class AudienceReader(DataSourceReader):
    def __init__(self, options):
        self.o = dict(options)

    def partitions(self):
        return [Lane(*x) for x in lanes(json.loads(self.o["requests"]), rate_of(self.o), int(self.o.get("lanes", 4)))]

    def read(self, p: Lane):
        from datetime import datetime, timezone

        country, version = self.o.get("country", "DE"), self.o.get("version", "")
        send = paced(recorded(self.o["dir"]) if "dir" in self.o else http(self.o["url"], self.o.get("token_env", "API_TOKEN")), p.interval)
        for r in p.jobs:
            body = estimate(send, targeting(r, country))
            first = next(iter(body.get("data") or []), {})
            low, high = first.get("estimate_mau_lower_bound"), first.get("estimate_mau_upper_bound")
            yield (country, r["platform_scope"], r["gender"], r["age_band"], r["age_min"], r["age_max"], low, high, version, datetime.now(timezone.utc), json.dumps(body, ensure_ascii=False))


def targeting(r: dict, country: str) -> dict:
    """The parameters of a request; a gender without values is not asked for."""
    spec = {"geo_locations": {"countries": [country]}, "age_min": r["age_min"], "age_max": r["age_max"], "publisher_platforms": r["platforms"]}
    if r["gender_values"]:
        spec["genders"] = r["gender_values"]
    return {"optimization_goal": "REACH", "targeting_spec": json.dumps(spec, separators=(",", ":")), "fields": "estimate_mau_lower_bound,estimate_mau_upper_bound"}


def estimate(send, params: dict, sleep=None, codes: tuple[int, ...] = Control.rate_codes) -> dict:
    """The body of the reply, after doubling waits where the server is busy."""
    import time

    for attempt in range(1, TRIES + 1):
        reply = send(params)
        error = reply.body.get("error") or {}
        if reply.status < 400 and not error:
            return reply.body
        if reply.status not in AGAIN and error.get("code") not in codes:
            raise RuntimeError(f"request failed: {reply.status} {error.get('message', '')}")
        (sleep or time.sleep)(doubling_wait(attempt, *WAITS))
    raise RuntimeError("the server stays busy")


def recorded(folder: str):
    """Replays recorded replies: the files of a folder hold a line {"targeting_spec", "body"} for each request."""
    from pathlib import Path

    lines = [json.loads(line) for f in sorted(Path(folder.removeprefix("file:")).glob("[!._]*")) for line in f.read_text(encoding="utf-8").splitlines()]
    bodies = {x["targeting_spec"]: x["body"] for x in lines}
    return lambda params: Reply(200, bodies.get(params["targeting_spec"], {"data": []}), {})


def read_estimates(spark: SparkSession, grid: DataFrame, **options) -> DataFrame:
    """grid: requests as pages.request_grid gives them, a few dozen."""
    spark.dataSource.register(AudienceEstimates)
    rows = [r.asDict() for r in grid.collect()]
    return spark.read.format("audience_estimates").options(requests=json.dumps(rows), **{k: str(v) for k, v in options.items()}).load()


def with_midpoint(estimates: DataFrame) -> DataFrame:
    """With the middle of both bounds, half to even; null where one is missing."""
    low, high = F.col("estimate_mau_lower_bound"), F.col("estimate_mau_upper_bound")
    return estimates.withColumn("estimate_mau_midpoint", F.bround((low + high) / 2).cast("long"))


def collect_estimates(spark: SparkSession, path: str, grid: DataFrame, batch: int = 16, country: str = "DE", **options) -> DataFrame:
    """Collects the grid into Parquet at `path`, with the replies as they came, and resumes a run that broke off: `batch` requests a job, and what is there is not asked for again."""
    while True:
        have = _table(spark, f"{path}/estimates", SCHEMA).select(*KEY).distinct()
        left = grid.withColumn("country", F.lit(country)).join(have, KEY, "left_anti").orderBy("platform_scope", "age_min", "age_max", "gender").limit(batch).drop("country")
        if left.isEmpty():
            return with_midpoint(spark.read.schema(SCHEMA).parquet(f"{path}/estimates")).drop("response")
        read_estimates(spark, left, country=country, **options).write.mode("append").parquet(f"{path}/estimates")
