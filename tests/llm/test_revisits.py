import random

import pytest

from ledgerline.llm.revisits import PERMITTED, canonical_url, crawl_log, resolve
from tests.llm.cases import MEDIUM, SMALL

SCHEMA = "record_id bigint, url string, at bigint, kind string, payload string, headers map<string,string>, status string"


def table(spark, rows):
    return spark.createDataFrame([(*row, "extra") for row in rows], SCHEMA)


def plain(rows, urls):
    out = {}
    for rid, url, at, kind, payload, headers in rows:
        own = {k.lower(): v for k, v in (headers or {}).items()}
        url = urls[url] if url is not None else None
        if kind == "response":
            out[rid] = ("full", None, payload, own)
            continue
        earlier = [
            (r[2], r[0], r[4], r[5])
            for r in rows
            if r[3] == "response" and None not in (url, at, r[1], r[2]) and urls[r[1]] == url and r[2] < at
        ]
        if not earlier:
            out[rid] = ("orphan", None, None, own)
            continue
        _, found, body, theirs = max(earlier, key=lambda e: e[:2])
        theirs = {k.lower(): v for k, v in (theirs or {}).items()}
        checks = [
            own[v].removeprefix("W/") == theirs[v].removeprefix("W/")
            for v in ("etag", "last-modified")
            if own.get(v) is not None and theirs.get(v) is not None
        ]
        if not checks:
            out[rid] = ("unvalidated", found, None, own)
        elif all(checks):
            out[rid] = ("resolved", found, body, theirs | {k: v for k, v in own.items() if k in PERMITTED})
        else:
            out[rid] = ("mismatch", found, None, own)
    return out


def found(frame):
    return {r.record_id: (r.status, r.response_id, r.payload, r.headers) for r in frame.collect()}


def rendered(expected):
    return {
        rid: (*rest, "\n".join(f"{k}: {v or ''}" for k, v in sorted(headers.items())))
        for rid, (*rest, headers) in expected.items()
    }


@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_equals_brute_force(spark, hot):
    rng = random.Random(11)
    urls = {f"http://h/{k}": f"h/{k}" for k in range(12)}
    rows = []
    for rid in range(600):
        url = "http://h/0" if rng.random() < hot else rng.choice([*urls, None])
        headers = {"ETag": rng.choice(['"a"', 'W/"a"', '"b"'])} if rng.random() < 0.7 else {}
        if rng.random() < 0.5:
            headers |= {"Last-Modified": rng.choice(["x", "y"]), "Date": str(rid), "X-Own": str(rid)}
        kind = "response" if rng.random() < 0.3 else "revisit"
        at = rng.choice([None, *range(200)])
        rows.append((rid, url, at, kind, f"p{rid}" if kind == "response" else None, headers or None))
    assert found(resolve(table(spark, rows).repartition(4))) == rendered(plain(rows, urls))


def test_canonical_urls(spark):
    urls = {
        "HTTP://Example.COM:80/a/B/": "example.com/a/B",
        "https://example.com/a/B#x?y": "example.com/a/B",
        "example.com": "example.com",
        "https://example.com/?utm_source=f": "example.com",
        "https://example.com/p?utm_source=f&a=1&utm_medium=g": "example.com/p?a=1",
        "https://example.com/p?a=1&b=2": "example.com/p?a=1&b=2",
        "https://example.com:8080/": "example.com:8080",
        "": "",
    }
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    rows = frame.select("url", canonical_url(frame.url).alias("c")).collect()
    assert {r.url: r.c for r in rows} == urls


def test_header_names_differ_in_case(spark):
    rows = [
        (1, "u", 1, "response", "p", {"ETag": "1", "X": "a"}),
        (2, "u", 2, "revisit", None, {"etag": "1", "VARY": "b", "vary": "c", "x": "not permitted"}),
    ]
    row = found(resolve(table(spark, rows)))[2]
    assert row[:3] == ("resolved", 1, "p")
    assert row[3] in ("etag: 1\nvary: b\nx: a", "etag: 1\nvary: c\nx: a")


def test_edges(spark):
    rows = [(None, None, None, None, None, None), (1, "u", 5, None, "p", None), (2, None, 3, "response", None, None)]
    got = found(resolve(table(spark, rows)))
    assert {k: v[0] for k, v in got.items()} == {None: "orphan", 1: "orphan", 2: "full"}
    assert resolve(table(spark, [])).collect() == []
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    log = crawl_log(pages)
    assert resolve(log).count() == log.count() == 2 * 50 + 10


def test_revisits_get_page_bodies(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    html = {4 * r.page_id: r.html for r in pages.collect()}
    rows = resolve(crawl_log(pages)).collect()
    resolved = [r for r in rows if r.status == "resolved"]
    assert resolved and all(r.payload == html[r.response_id] for r in resolved)
    assert sorted(r.payload for r in rows if r.status == "full") == sorted(html.values())


def test_moments_and_outliers(spark):
    """One URL with all records, many of one moment, and one far away in time; equal ids; long bodies."""
    rows = [(1, "u", 0, "response", "far", {"ETag": "0"})]
    rows += [(2 + i, "u", 10**9 + i // 50, "response" if i % 7 == 0 else "revisit", "x" * 50_000 if i == 7 else f"p{i}", {"ETag": str(i // 100)}) for i in range(1500)]
    rows += [(9000, "u", 10**9 + 40, "response", "b", {"ETag": "8"}), (9000, "u", 10**9 + 40, "response", "a", {"ETag": "8"})]
    expected = rendered(plain(rows, {"u": "u"}))
    named = [(*row, "x", 1) for row in rows]
    kind = "record_id bigint, url string, at bigint, kind string, payload string, headers map<string,string>, status string, found bigint"
    frame = spark.createDataFrame(named, kind).repartition(6)
    got = found(resolve(frame))
    assert {k: v for k, v in got.items() if k != 9000} == {k: v for k, v in expected.items() if k != 9000}


def test_derived_log_has_every_status(spark):
    log = crawl_log(spark.read.parquet(f"{MEDIUM}/pages.parquet"))
    counts = {r.status: r.n for r in resolve(log).groupBy("status").count().withColumnRenamed("count", "n").collect()}
    assert counts.keys() == {"full", "resolved", "mismatch", "unvalidated", "orphan"}
    several = log.where("kind = 'response'").groupBy("url").count().where("count > 1")
    assert several.count() > 3
