import random
from collections import Counter

from repoweave.llm import url_lists

CAPTURES = "page_id long, url string, fetched_at long, host string, list string"
YEAR = 1_704_067_200
EVENTS = "list string, domain string, at long, action string, note string"


def active(events, name, domain, at):
    """Whether the last event up to ``at`` put the domain on the list; a removal wins a tie."""
    own = [(e[2], e[3] == "remove") for e in events if None not in e[:4] and e[0] == name and e[1].lower() == domain and e[2] <= at]
    return bool(own) and not max(own)[1]


def test_every_capture_against_the_entries_of_its_time(spark):
    rng = random.Random(2)
    hosts = ["a.b.example.com", "b.example.com", "example.com", "x.example.org", "EXAMPLE.org", "hot.example.net"]
    domains = [h.lower() for h in hosts] + ["com", "unused.example.net"]
    day = 86_400
    events = [
        (rng.choice(["block", "allow"]), rng.choice(domains), rng.randrange(0, 400) * day + rng.choice([0, 7]),
         rng.choice(["add", "add", "remove"]), "n")
        for _ in range(120)
    ]
    events += [(None, "example.com", 0, "add", "n"), ("block", None, 0, "add", "n"), ("block", "com", None, "add", "n"), ("block", "com", 5, None, "n")]
    captures = [
        (i, f"https://u@{rng.choice(hosts)}:80/p?q={i}" if i % 3 else f"http://{rng.choice(hosts[-1:])}/x", rng.randrange(-50, 450) * day, None, None)
        for i in range(400)
    ]
    captures += [(1000, None, 5, None, None), (1001, "no host", 5, None, None), (1002, "http://example.com/", None, None, None)]
    far = [-(1 << 63), (1 << 63) - 1, YEAR * 10**6, -YEAR * 10**6, 2**53 * 1000 + 1]
    events += [("allow", "example.org", t, rng.choice(["add", "remove"]), "n") for t in far]
    events += [("block", "net", -(1 << 63), "add", "n"), ("block", "net", YEAR, "remove", "n")]
    captures += [(2000 + i, f"http://{h}/", t + d, None, None) for i, (h, t, d) in enumerate(
        (h, t, d) for h in hosts for t in far for d in (-1, 0, 1) if abs(t + d) < 1 << 63 or t + d == -(1 << 63))]
    captures += [(1003, "http://" + "a." * 200 + "com/", 5 * day, None, None), (None, "ftp://example.com./", 399 * day, None, None)] * 2
    got = url_lists.filter_captures(
        spark.createDataFrame(captures, CAPTURES).repartition(4), spark.createDataFrame(events, EVENTS)
    ).collect()
    want = Counter()
    for page, url, at, _, _ in captures:
        host = next((h.lower() for h in sorted(hosts, key=len, reverse=True) if url and h in url.split("/")[2:][0]), None) if url and "//" in url else None
        if url and "a.a.a" in url:
            host = None
        kept = True
        if host and at is not None:
            parts = host.split(".")
            for i in range(len(parts)):
                domain = ".".join(parts[i:])
                on = [name for name in ("allow", "block") if active(events, name, domain, at)]
                if on:
                    kept = on[0] == "allow"
                    break
        want[(page, url, kept)] += 1
    assert Counter((r["page_id"], r["url"], r["kept"]) for r in got) == want
    assert any(not r["kept"] for r in got)


def test_no_rows(spark):
    none, no_events = spark.createDataFrame([], CAPTURES), spark.createDataFrame([], EVENTS)
    some = spark.createDataFrame([(1, "http://a.com/", 5, None, None)], CAPTURES)
    assert url_lists.filter_captures(none, no_events).collect() == []
    assert [r["kept"] for r in url_lists.filter_captures(some, no_events).collect()] == [True]


def test_times_as_text_and_a_domain_above_all_hosts(spark):
    events = spark.createDataFrame([("block", "com", "100", "add"), ("block", "com", "soon", "remove")], "list string, domain string, at string, action string")
    rows = [(i, f"http://h{i}.com/", t) for i, t in enumerate(["99", "100", "never", None, str(1 << 62)])]
    got = url_lists.filter_captures(spark.createDataFrame(rows, "page_id long, url string, fetched_at string"), events)
    assert {r["page_id"]: r["kept"] for r in got.collect()} == {0: True, 1: False, 2: True, 3: True, 4: False}
