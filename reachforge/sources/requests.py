"""Request control of paginated sources: retries, waits, page sizes and splits. Pure functions but for the fetch loop."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from hashlib import sha256

from ..functions.dates import bisect


@dataclass
class Reply:
    status: int
    body: dict
    headers: dict


@dataclass(frozen=True)
class Control:
    page_sizes: tuple[int, ...] = (250, 100, 50, 25)
    page_delay: float = 1.0
    network_retries: int = 5
    network_wait: float = 60.0
    network_wait_most: float = 300.0
    rate_waits: int = 8
    rate_wait: float = 300.0
    rate_wait_most: float = 1800.0
    retry_after_least: float = 30.0
    rate_codes: tuple[int, ...] = (4, 17, 32, 613)
    #: First and longest wait of failed connections that double; None: they rise by network_wait.
    doubling: tuple[float, float] | None = None
    too_much: tuple[str, ...] = ("reduce the amount of data", "too much data", "timeout", "timed out")


class TooMuchData(RuntimeError):
    """The smallest page size is still too large: the range must be split."""


class Pace:
    """Keeps requests of one task at least `interval` seconds apart, also the first from whatever an attempt before this one sent."""

    def __init__(self, interval: float, clock=time.monotonic, sleep=time.sleep):
        self.interval, self.clock, self.sleep = interval, clock, sleep
        self.due = clock() + interval

    def wait(self) -> None:
        now = self.clock()
        if now < self.due:
            self.sleep(self.due - now)
        self.due = max(now, self.due) + self.interval


def paced(send: Callable[[dict], Reply], interval: float) -> Callable[[dict], Reply]:
    """Every request that is sent, repeated ones too, waits for its turn."""
    if not interval:
        return send
    pace = Pace(interval)

    def wait_and_send(params: dict) -> Reply:
        pace.wait()
        return send(params)

    return wait_and_send


def lanes(jobs: list, rate: float | None, most: int) -> list[tuple[list, float]]:
    """Deals jobs out to tasks so that a server's limit of `rate` requests a second holds over all of them, wherever they run: each of at most `most` lanes is one task and has an equal share of the rate, so no task needs to know of another. Without a rate each job is a task of its own. Returns (jobs, seconds between requests) of each lane. Over any T seconds at most rate * T requests are sent and one more a lane."""
    if rate is None:
        return [([j], 0.0) for j in jobs]
    n = max(1, min(most, len(jobs)))
    return [(jobs[k::n], n / rate) for k in range(n) if jobs[k::n]]


def rate_limited(r: Reply, c: Control) -> bool:
    error = r.body.get("error") or {}
    return r.status == 429 or error.get("code") in c.rate_codes or bool(error.get("is_transient") and r.status < 500)


def too_much(r: Reply, c: Control) -> bool:
    text = str((r.body.get("error") or {}).get("message", "")).lower()
    return r.status >= 500 or any(p in text for p in c.too_much)


def network_wait(attempt: int, c: Control) -> float:
    return doubling_wait(attempt, *c.doubling) if c.doubling else min(c.network_wait * attempt, c.network_wait_most)


def rate_wait(attempt: int, headers: dict, c: Control) -> float:
    """The server's own wish if it gives one, else a rising wait."""
    wish = str(next((v for k, v in headers.items() if k.lower() == "retry-after"), "")).strip()
    return max(c.retry_after_least, float(wish)) if wish.isdigit() else min(c.rate_wait * attempt, c.rate_wait_most)


def doubling_wait(attempt: int, first: float, most: float) -> float:
    return min(first * 2 ** (attempt - 1), most)


def fetch(send: Callable[[dict], Reply], params: dict, c: Control, sleep=time.sleep) -> Reply:
    """One request, with retries of failed connections and waits for rate limits."""
    failed = waited = 0
    while True:
        try:
            reply = send(params)
        except OSError:
            failed += 1
            if failed > c.network_retries:
                raise
            sleep(network_wait(failed, c))
            continue
        if not rate_limited(reply, c):
            return reply
        waited += 1
        if waited > c.rate_waits:
            raise RuntimeError("rate limit does not end")
        sleep(rate_wait(waited, reply.headers, c))


def too_large(send: Callable[[dict], Reply], params: dict, start: date, end: date, c: Control, sleep=time.sleep) -> bool:
    """Whether the server refuses even the smallest first page of a date range."""
    reply = fetch(send, params | {"date_min": start.isoformat(), "date_max": end.isoformat(), "limit": c.page_sizes[-1]}, c, sleep)
    return (reply.status != 200 or "error" in reply.body) and too_much(reply, c)


def pages(send: Callable[[dict], Reply], params: dict, c: Control, sleep=time.sleep) -> list:
    """The items of all pages. When a page is too large, all begins anew with the next smaller size, as a cursor carries the size that it was made with; after the smallest, TooMuchData."""
    for size in c.page_sizes:
        items, after = [], None
        while True:
            reply = fetch(send, params | {"limit": size} | ({"after": after} if after else {}), c, sleep)
            if reply.status != 200 or "error" in reply.body:
                if not too_much(reply, c):
                    raise RuntimeError(f"request failed: {reply.status} {(reply.body.get('error') or {}).get('message', '')}")
                break
            items += reply.body.get("data", [])
            after = (reply.body.get("paging") or {}).get("next")
            if not after:
                return items
            sleep(c.page_delay)
    raise TooMuchData(str(params))


def collect_range(send, params: dict, start: date, end: date, c: Control, sleep=time.sleep):
    """Items of a date range, each with the bounds of the segment that gave it. A range that is too large is split in two, again and again; what it gave before is dropped."""
    pending = [(start, end)]
    while pending:
        a, b = pending.pop()
        try:
            items = pages(send, params | {"date_min": a.isoformat(), "date_max": b.isoformat()}, c, sleep)
        except TooMuchData:
            if a == b:
                raise
            first, second = bisect(a, b)
            pending += [second, first]
            continue
        yield from ((a, b, x) for x in items)


def settings_fingerprint(settings: dict) -> str:
    """A run may resume only under the settings that it began with."""
    return sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def refuse_changed(saved: dict | None, settings: dict) -> str:
    mark = settings_fingerprint(settings)
    if saved and saved.get("settings") != mark:
        raise ValueError("settings differ from those of the run to resume")
    return mark


def choose(names: list[str], wanted: str | None) -> list[str]:
    """A subset by comma-separated names without regard to case; unknown ones are an error."""
    if not wanted:
        return names
    by = {n.casefold(): n for n in names}
    asked = [w.strip() for w in wanted.split(",") if w.strip()]
    if unknown := [w for w in asked if w.casefold() not in by]:
        raise ValueError(f"unknown: {', '.join(unknown)}")
    return [n for n in names if n.casefold() in {w.casefold() for w in asked}]
