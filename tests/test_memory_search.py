"""What tasks hold does not grow with the rows of their input: recorded results."""

import json
import random
import tracemalloc

from reachforge.sources import search


def replayed(folder, term, limit=250):
    send, after = search.recorded(str(folder), term), None
    while True:
        reply = send({"limit": limit} | ({"after": after} if after else {}))
        yield from reply.body["data"]
        after = reply.body["paging"].get("next")
        if not after:
            return


def test_recorded_results_are_replayed_by_pages(tmp_path):
    for k in range(4):
        lines = [json.dumps({"term": t, "at": at, "ad": {"page_id": str(at), "page_name": "x" * 500}}) for at in range(5000 * k, 5000 * (k + 1)) for t in ("a", "b")]
        (tmp_path / f"part-{k}").write_text("\n".join(lines) + "\n")
    tracemalloc.start()
    assert [ad["page_id"] for ad in replayed(tmp_path, "a")] == [str(k) for k in range(20_000)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3_000_000  # all ads of the term are 20 MB and more


def test_recorded_results_in_any_order_and_pages_asked_for_again(tmp_path):
    rows = [(t, k % 90) for t in ("a", "b") for k in range(200)]
    random.Random(3).shuffle(rows)
    for k in range(3):
        (tmp_path / f"part-{k}").write_text("\n".join(json.dumps({"term": t, "at": at, "ad": [i, t, at]}, ensure_ascii=False) for i, (t, at) in list(enumerate(rows))[k * 150 : (k + 1) * 150]))
    expected = sorted(([i, t, at] for i, (t, at) in enumerate(rows) if t == "b"), key=lambda x: x[2])
    for limit in (1, 7, 200, 1000):
        assert list(replayed(tmp_path, "b", limit)) == expected
    send = search.recorded(str(tmp_path), "b")
    for after in (0, 7, 7, 0, 14):
        assert send({"limit": 7, "after": str(after)}).body["data"] == expected[after : after + 7]
    assert send({"limit": 7, "after": "200"}).body == {"data": [], "paging": {}} and list(replayed(tmp_path, "none")) == []
