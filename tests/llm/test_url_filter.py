"""URL lists against a day-by-day evaluation."""

import datetime as dt
import random
import re

from claimscope.llm.url_filter import evaluate, intervals

DAY = dt.date(2024, 1, 1)
URL = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?(/[^?#]*)?")


def active(entries, key, day):
    """Verdicts of (list, scope, pattern, verdict) that are on at the day."""
    events = {}
    for name, scope, pattern, verdict, action, when in entries:
        if when is not None and when <= day and (scope, pattern) == key:
            best = events.get((name, verdict))
            if best is None or (when, action) > best:
                events[(name, verdict)] = (when, action)
    return [(name, verdict, when) for (name, verdict), (when, action) in events.items() if action == "add"]


def expected(url, day, entries):
    m = URL.match((url or "").lower())
    if not m or day is None:
        return ("none", 0)
    host = m[1].rstrip(".") if m[1].endswith(".") else m[1]
    labels = host.split(".")
    keys = [("domain", ".".join(labels[-k:]), k) for k in range(1, len(labels) + 1)] + [("host", host, 1000)]
    parts = [p for p in (m[2] or "").split("/") if p]
    keys += [("path", host + "/" + "/".join(parts[:k]), 1_000_000 + k) for k in range(1, len(parts) + 1)]
    hits = [(weight, verdict) for scope, pattern, weight in keys for _, verdict, _ in active(entries, (scope, pattern), day)]
    return (max(hits)[1], len(hits)) if hits else ("none", 0)


def test_against_each_day(spark):
    rng = random.Random(6)
    hosts = ["a.example.com", "b.example.com", "example.com", "x.y.example.org", "hot.example.net"]
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'me:pw@'])}{rng.choice(hosts)}{rng.choice(['', ':8080', '.'])}{rng.choice(['', '/', '/p/q', '/P/r?z=1', '#f'])}" for _ in range(60)]
    urls += ["http://hot.example.net/p"] * 40 + [None, "", "no url", "http://", "http://" + "long." * 200 + "com/" + "s/" * 300]
    caps = [(i, u, DAY + dt.timedelta(days=rng.randrange(40))) for i, u in enumerate(urls)] + [(500, urls[0], None), (501, urls[0], DAY), (501, urls[0], DAY)]
    patterns = [("domain", d) for d in ("com", "example.com", "example.org", "hot.example.net")] + [("host", h) for h in hosts] + [("path", "a.example.com/p"), ("path", "hot.example.net/p"), ("path", "b.example.com/p/q")]
    entries = []
    for scope, pattern in patterns:
        for _ in range(rng.randrange(1, 7)):
            entries.append((rng.choice(["l1", "l2"]), scope, pattern, rng.choice(["allow", "block"]), rng.choice(["add", "add", "remove"]), DAY + dt.timedelta(days=rng.randrange(40))))
    entries += [entries[0], ("l1", "host", hosts[0], "block", "add", None), ("l1", None, None, "block", "add", DAY)]
    c = spark.createDataFrame(caps, "page_id bigint, url string, fetched date").selectExpr("*", "1 AS id", "2 AS copies", "'x' AS pattern")
    e = spark.createDataFrame(entries, "list_name string, scope string, pattern string, verdict string, action string, day date")
    got = evaluate(c, e).collect()
    assert len(got) == len(set(caps))
    for r in got:
        assert (r["action"], r["n_active"]) == expected(r["url"], r["fetched"], entries), r
        assert r["copies"] == caps.count((r["page_id"], r["url"], r["fetched"]))


def test_intervals_and_no_rows(spark):
    day = lambda n: DAY + dt.timedelta(days=n)
    rows = [("l", "host", "h", "block", a, day(n)) for a, n in (("add", 0), ("add", 0), ("remove", 5), ("add", 7), ("remove", 7), ("add", 9))]
    schema = "list_name string, scope string, pattern string, verdict string, action string, day date"
    got = sorted((r["since"], r["until"]) for r in intervals(spark.createDataFrame(rows, schema)).collect())[:1]
    assert got == [(day(0), day(5))]
    none = spark.createDataFrame([], schema)
    caps = spark.createDataFrame([(1, "http://h/", DAY)], "page_id bigint, url string, fetched date")
    assert [r["action"] for r in evaluate(caps, none).collect()] == ["none"]
    assert evaluate(caps.limit(0), spark.createDataFrame(rows, schema)).collect() == []
