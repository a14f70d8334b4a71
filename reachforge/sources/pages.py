"""Paginated sources as Spark data sources, read on the executors: an input partition for each entity and date range, or, under a rate limit, for each lane of them."""

from __future__ import annotations

import json
from datetime import date, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas as S
from .requests import Control, Reply, bisect, collect_range, lanes, paced, refuse_changed, too_large


class Range(NamedTuple):
    brand: str
    sector: str
    page_id: str
    start: str
    end: str


class Lane(InputPartition):
    """What one task asks for, one after the other, and how many seconds lie between its requests."""

    def __init__(self, jobs: list, interval: float):
        self.jobs, self.interval = jobs, interval


class PagedAds(DataSource):
    """Options: either entities (JSON list of [brand, sector, page id]) with start, end and days (of a range), or ranges (JSON list of [brand, sector, page id, first day, last day], as plan_ranges gives them); done (JSON list of [page id, first day, last day] of segments to leave out); rate (requests a second, of all tasks together) and lanes (tasks that share it); and either dir (folder of recorded pages, <page id>/*.json) or url with token_env (the environment variable that holds the token on executors). Ranges are passed as options through the driver: as many as segments are asked for."""

    @classmethod
    def name(cls) -> str:
        return "paged_ads"

    def schema(self) -> str:
        return "search_brand string, sector string, payload string, query_date_min string, query_date_max string, seq long, collection_timestamp string"

    def reader(self, schema):
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.o = dict(options)

    def ranges(self) -> list[Range]:
        done = {tuple(x) for x in json.loads(self.o.get("done", "[]"))}
        if "ranges" in self.o:
            every = [Range(*x) for x in json.loads(self.o["ranges"])]
        else:
            every = day_ranges(json.loads(self.o["entities"]), self.o["start"], self.o["end"], int(self.o.get("days", 90)))
        return [r for r in every if (r.page_id, r.start, r.end) not in done]

    def partitions(self):
        return [Lane(*x) for x in lanes(self.ranges(), rate_of(self.o), int(self.o.get("lanes", 4)))]

    def read(self, p: Lane):
        from datetime import datetime, timezone

        control = Control(page_delay=float(self.o.get("page_delay", 1.0)))
        for r in p.jobs:
            r = Range(*r)
            now = datetime.now(timezone.utc).isoformat(timespec="seconds")
            send = paced(sender(self.o, r.page_id), p.interval)
            for k, (a, b, item) in enumerate(collect_range(send, {"page_id": r.page_id}, date.fromisoformat(r.start), date.fromisoformat(r.end), control)):
                yield (r.brand, r.sector, json.dumps(item, ensure_ascii=False), a.isoformat(), b.isoformat(), k, now)


def rate_of(options: dict) -> float | None:
    return float(options["rate"]) if "rate" in options else None


def day_ranges(entities: list, start: str, end: str, days: int) -> list[Range]:
    first, last, out = date.fromisoformat(start), date.fromisoformat(end), []
    for entity in entities:
        a = first
        while a <= last:
            b = min(last, a + timedelta(days=days - 1))
            out.append(Range(*entity, a.isoformat(), b.isoformat()))
            a = b + timedelta(days=1)
    return out


def sender(options: dict, page_id: str):
    return recorded(options["dir"], page_id) if "dir" in options else http(options["url"], options.get("token_env", "API_TOKEN"))


def plan_ranges(spark: SparkSession, entities: list[tuple[str, str, str]], start: str, end: str, days: int = 90, rate: float | None = None, lanes_most: int = 8, make_sender=sender, **options) -> list[Range]:
    """Ranges that the server does not refuse for their size, found before anything is read: in each round all ranges in question are probed side by side, with one smallest page each, and those refused are split in two. So the segments of a hot page are read by many tasks, and not one after the other by the task that happens on them. As many rounds as a range can be halved; what reaches the driver is a list of the segments that will be asked for. A range that is refused only on a later page is still split while it is read."""
    settled, open_ = [], day_ranges(entities, start, end, days)
    while open_:
        dealt = lanes(open_, rate, lanes_most) if rate else [(open_[k::lanes_most], 0.0) for k in range(lanes_most) if open_[k::lanes_most]]

        def probe(batches, dealt=dealt):
            import pyarrow as pa

            for batch in batches:
                for k in batch.column(0).to_pylist():
                    jobs, interval = dealt[k]
                    refused = []
                    for r in jobs:
                        a, b = date.fromisoformat(r.start), date.fromisoformat(r.end)
                        refused.append(a < b and too_large(paced(make_sender(options, r.page_id), interval), {"page_id": r.page_id}, a, b, Control()))
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(jobs), pa.int64()), pa.array(range(len(jobs)), pa.int64()), pa.array(refused, pa.bool_())], ["lane", "at", "refused"])

        probed = [(dealt[lane][0][at], refused) for lane, at, refused in spark.range(0, len(dealt), 1, len(dealt)).mapInArrow(probe, "lane long, at long, refused boolean").collect()]
        settled += [r for r, refused in probed if not refused]
        halves = [(r[:3], bisect(date.fromisoformat(r.start), date.fromisoformat(r.end))) for r, refused in probed if refused]
        open_ = [Range(*entity, *(x.isoformat() for x in half)) for entity, two in halves for half in two]
    return sorted(settled)


def recorded(folder: str, page_id: str):
    """Replays recorded items whose start date lies in the range asked for."""
    from pathlib import Path

    items = [x for f in sorted(Path(folder, page_id).glob("*.json")) for x in json.loads(f.read_text(encoding="utf-8"))["data"]]

    def send(params: dict) -> Reply:
        inside = [x for x in items if params["date_min"] <= str(x.get("ad_delivery_start_time", ""))[:10] <= params["date_max"]]
        at, n = int(params.get("after") or 0), params["limit"]
        more = {"next": str(at + n)} if at + n < len(inside) else {}
        return Reply(200, {"data": inside[at : at + n], "paging": more}, {})

    return send


def http(url: str, token_env: str):
    import os
    from urllib.error import HTTPError
    from urllib.parse import urlencode
    from urllib.request import urlopen

    token = os.environ[token_env]

    def send(params: dict) -> Reply:
        after = params.get("after")
        target = after if after else f"{url}?{urlencode(params | {'access_token': token})}"
        try:
            with urlopen(target, timeout=180) as r:  # noqa: S310
                return Reply(r.status, json.load(r), dict(r.headers))
        except HTTPError as e:
            try:
                body = json.load(e)
            except ValueError:
                body = {}
            return Reply(e.code, body, dict(e.headers))

    return send


def read_ads(spark: SparkSession, entities: list[tuple[str, str, str]], start: str, end: str, **options) -> DataFrame:
    """Raw ad rows (bronze): 24 text columns with the segment's bounds and the order of arrival."""
    spark.dataSource.register(PagedAds)
    raw = spark.read.format("paged_ads").options(entities=json.dumps(entities), start=start, end=end, **{k: str(v) for k, v in options.items()}).load()
    return to_raw(raw)


def collect_ads(spark: SparkSession, path: str, entities: list[tuple[str, str, str]], start: str, end: str, batch: int = 200, planned: bool = False, **options) -> DataFrame:
    """Collects all segments into Parquet at `path`, `batch` entities a job, and resumes a run that broke off: a job's rows and the list of its segments are written before the next one begins, and listed segments are not asked for again. planned: ranges are probed, and split, before they are read (plan_ranges). Settings that differ from those of the first run are an error."""
    settings = refuse_changed(_saved(spark, f"{path}/settings"), {"start": start, "end": end, "days": str(options.get("days", 90))})
    spark.createDataFrame([(settings,)], "settings string").write.mode("overwrite").json(f"{path}/settings")
    ledger = "page string, first string, last string, job string"
    done = {(r["page"], r["first"], r["last"]) for r in _table(spark, f"{path}/done", ledger).collect()}  # as many as segments were asked for
    for k in range(0, len(entities), batch):
        part = entities[k : k + batch]
        days = int(options.get("days", 90))
        every = plan_ranges(spark, part, start, end, days, **{k: v for k, v in options.items() if k in ("dir", "url", "token_env", "rate")}) if planned else day_ranges(part, start, end, days)
        left = [r for r in every if (r.page_id, r.start, r.end) not in done]
        if not left:
            continue
        rows = read_ads(spark, part, start, end, ranges=json.dumps(left), **options)
        job = refuse_changed(None, {"segments": [(p.page_id, p.start, p.end) for p in left]})
        rows.write.mode("overwrite").parquet(f"{path}/rows/job={job}")  # a job that broke off is written anew
        spark.createDataFrame([(p.page_id, p.start, p.end, job) for p in left], ledger).write.mode("append").parquet(f"{path}/done")
    jobs = [r[0] for r in _table(spark, f"{path}/done", ledger).select("job").distinct().collect()]  # one a job
    return spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/job={j}" for j in jobs]).drop("job")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _saved(spark: SparkSession, path: str) -> dict | None:
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.schema("settings string").json(path).first()
    except AnalysisException:
        return None
    return row.asDict() if row else None


def to_raw(pages: DataFrame, country: str = "DE") -> DataFrame:
    p = pages.withColumn("p", F.from_json("payload", S.PAYLOAD))
    text = lambda name: F.coalesce(F.to_json(F.col("p")[name]), F.lit(""))
    plain = lambda name: F.coalesce(F.col("p")[name], F.lit(""))
    flat = demographics(F.col("p")["age_country_gender_reach_breakdown"], country)
    cols = [
        "search_brand", "sector", F.col("p.id").alias("meta_ad_id"), *[text(c).alias(c) for c in [*S.CREATIVE, S.PLATFORMS, "target_ages"]], plain("target_gender").alias("target_gender"),
        plain("ad_delivery_start_time").alias(S.START), plain("ad_delivery_stop_time").alias(S.STOP), "collection_timestamp",
    ]
    return p.withColumn("_d", flat).select(*cols, *[F.coalesce(F.col("_d")[c].cast("string"), F.lit("")).alias(c) for c in S.REACH], F.col("query_date_min").alias("_query_date_min"), F.col("query_date_max").alias("_query_date_max"), F.col("seq").alias("_seq"))


def demographics(breakdown: Column, country: str) -> Column:
    """A struct of the reach columns for a country; null where it has no entry. Inside an entry a missing count is zero. Two entries, an unknown label or a repeated age are errors."""
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  computed once
    mine = F.filter(breakdown, lambda x: x["country"] == country)
    flat = F.transform(F.flatten(F.transform(mine, lambda x: x["age_gender_breakdowns"])), lambda a: F.struct(label(a["age_range"]).alias("age"), *[F.coalesce(a[g], F.lit(0)).alias(g) for g in ("male", "female", "unknown")]))
    fail = lambda text: F.raise_error(F.lit(text)).cast(value_type())

    def reach(ages: Column) -> Column:
        total = lambda g: F.aggregate(ages, F.lit(0).cast("long"), lambda s, a: s + a[g])
        by_age = lambda name: F.aggregate(ages, F.lit(0).cast("long"), lambda s, a: s + F.when(a["age"] == name, a["male"] + a["female"] + a["unknown"]).otherwise(0))
        value = F.struct(total("male").alias("de_male"), total("female").alias("de_female"), total("unknown").alias("de_unknown"), *[by_age(k).alias(v) for k, v in S.AGE_LABELS.items()])
        wrong = F.exists(ages, lambda a: ~a["age"].isin(*S.AGE_LABELS))
        repeated = F.size(F.array_distinct(F.transform(ages, lambda a: a["age"]))) < F.size(ages)
        return F.when(wrong, fail("unknown age label")).when(repeated, fail("repeated age")).otherwise(value)

    return F.when(F.size(mine) > 1, fail("more than one entry of the country")).when(F.size(mine) == 1, let(flat, reach))


def value_type() -> str:
    return "struct<" + ",".join(f"{c}:bigint" for c in S.REACH) + ">"


def label(age: Column) -> Column:
    return F.when(F.lower(F.trim(age)) == "unknown", "unknown").otherwise(F.trim(age))


def request_grid(spark: SparkSession, scopes: dict[str, list[str]], genders: dict[str, list[int] | None], bands: list[tuple[str, int, int]], whole: tuple[str, int, int] = ("18-65+", 18, 65)) -> DataFrame:
    """All requests of an audience benchmark: scopes x genders over the whole range, and over each band."""
    grid = [(s, p, g, v, *band) for s, p in scopes.items() for band in (whole, *bands) for g, v in genders.items()]
    return spark.createDataFrame(grid, "platform_scope string, platforms array<string>, gender string, gender_values array<int>, age_band string, age_min int, age_max int")
