"""Keyword search for pages as a Spark data source: an input partition for each search term, or, under a rate limit, for each lane of them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..operators.entities import tally
from .pages import Lane, http, rate_of
from .requests import Control, Reply, fetch, lanes, paced


class PageSearch(DataSource):
    """Options: terms (JSON list of [brand, term], in the order in which they are searched), params (JSON object of further request parameters), limit (of a page), most (pages of a term), rate and lanes (requests a second over all tasks, and tasks that share them), and either dir (recorded results, see `recorded`) or url with token_env."""

    @classmethod
    def name(cls) -> str:
        return "page_search"

    def schema(self) -> str:
        return "search_brand string, term string, term_at int, page_id string, page_name string, seq long"

    def reader(self, schema):
        return SearchReader(self.options)


class SearchReader(DataSourceReader):
    def __init__(self, options):
        self.o = dict(options)

    def partitions(self):
        jobs = [(k, brand, term) for k, (brand, term) in enumerate(json.loads(self.o["terms"]))]
        return [Lane(*x) for x in lanes(jobs, rate_of(self.o), int(self.o.get("lanes", 4)))]

    def read(self, p: Lane):
        control = Control(page_delay=float(self.o.get("page_delay", 1.0)), network_retries=20, rate_waits=20, doubling=(5.0, 120.0))
        for at, brand, term in p.jobs:
            send = paced(recorded(self.o["dir"], term) if "dir" in self.o else http(self.o["url"], self.o.get("token_env", "API_TOKEN")), p.interval)
            for k, ad in enumerate(found(send, {"search_terms": term} | json.loads(self.o.get("params", "{}")), int(self.o.get("limit", 250)), int(self.o.get("most", 20)), control)):
                if page := str(ad.get("page_id") or "").strip():
                    yield (brand, term, at, page, str(ad.get("page_name") or "").strip(), k)


def found(send, params: dict, limit: int, most: int, control: Control, sleep=None):
    """The ads of a term, page after page, of at most so many pages. Failed connections and rate limits are waited for; other refusals are errors."""
    import time

    after = None
    for k in range(most):
        if k:
            (sleep or time.sleep)(control.page_delay)
        reply = fetch(send, params | {"limit": limit} | ({"after": after} if after else {}), control, sleep or time.sleep)
        if reply.status >= 400:
            raise RuntimeError(f"search failed: {reply.status} {(reply.body.get('error') or {}).get('message', '')}")
        yield from reply.body.get("data", [])
        after = (reply.body.get("paging") or {}).get("next")
        if not after:
            return


def recorded(folder: str, term: str):
    """Replays recorded results: the files of a folder hold a line {"term", "at", "ad"} for each ad, with its place among those of the term.

    No more than a page is held. Where the files, by name, hold the term's ads in order of their places, as `record` writes them, they are read on from page to page; else the places of the ads and of their lines are held, 24 bytes an ad."""
    from itertools import islice
    from pathlib import Path

    files = sorted(Path(folder.removeprefix("file:")).glob("[!._]*"))
    under_way: dict = {}

    def send(params: dict) -> Reply:
        at, n = int(params.get("after") or 0), params["limit"]
        if under_way.get("at") != at:  # the first page, or one that is asked for again
            under_way["ads"] = islice(in_order(files, term), at, None)
            under_way["next"] = list(islice(under_way["ads"], 1))
        page = under_way["next"] + list(islice(under_way["ads"], n))
        under_way.update(at=at + n, next=page[n:])
        return Reply(200, {"data": page[:n], "paging": {"next": str(at + n)} if page[n:] else {}}, {})

    return send


def in_order(files: list, term: str):
    """The term's ads by their places, of equal places by file and line."""
    from array import array

    def lines():
        for k, f in enumerate(files):
            with f.open("rb") as stream:
                start = 0
                for line in stream:
                    x = json.loads(line)
                    if x["term"] == term:
                        yield x["at"], k, start, x["ad"]
                    start += len(line)

    before = float("-inf")
    for place, *_ in lines():
        if place < before:
            break
        before = place
    else:
        yield from (ad for *_, ad in lines())
        return

    import numpy as np

    places, numbers, starts = array("q"), array("q"), array("q")
    for place, k, start, _ in lines():
        places.append(place)
        numbers.append(k)
        starts.append(start)
    opened, stream = None, None
    for i in np.argsort(np.array(places, np.int64), kind="stable"):
        if numbers[i] != opened:
            if stream:
                stream.close()
            opened, stream = numbers[i], files[numbers[i]].open("rb")
        stream.seek(starts[i])
        yield json.loads(stream.readline())["ad"]
    stream.close()


def record(ads: DataFrame, path: str) -> None:
    """Writes results for `recorded`, in order. ads: term, at (place among those of the term), ad (struct)."""
    line = F.to_json(F.struct("term", "at", "ad"))
    ads.orderBy("term", "at").select(line.alias("value")).write.text(path)


def search_pages(spark: SparkSession, terms: list[tuple[str, str]], **options) -> DataFrame:
    """An ad a row: search_brand, term, term_at (place of the term), page_id, page_name, seq (place among the term's ads). Ads without a page are left out."""
    spark.dataSource.register(PageSearch)
    return spark.read.format("page_search").options(terms=json.dumps(terms), **{k: str(v) for k, v in options.items()}).load()


def candidates(hits: DataFrame) -> DataFrame:
    """By brand and page: the number of ads over all terms of the brand, one counted for each term that gives it, and the name seen last in the order of the terms."""
    return tally(hits, ["search_brand", "page_id"], "page_name", F.struct("term_at", "seq"))
