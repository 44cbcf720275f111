"""Resolving WARC revisit records of unchanged pages.

A server that answers "not modified" leaves a revisit record without a
body. It is joined, as of its time, to the latest earlier full response of
the same canonical URL. If the validators agree the record is resolved: it
gets that response's payload, and its headers updated by those that a
not-modified answer may bring.

A URL may hold any share of the records, and so may a moment of it. Records
are first summed up to one row per URL and time. These rows are dealt over
tasks by ranges of URL and time, as many to each, so a URL's time line is cut
by rank, whatever its outliers: within a task a window finds the latest
response, and the last response of each task is carried on to the later ones.
Payloads may be whole bodies: none of this carries any, and each record gets
its own after that, by the key of its response.

Defined results: full responses pass with status `full`; a revisit is
`resolved`, `mismatch` (an entity tag or modification time differs),
`unvalidated` (no validator on both sides) or `orphan` (no earlier full
response, or no URL or time); of responses of the same time the one with
the larger record id is the latest, and of equal ids the larger payload counts; responses of that same time as the
revisit are not earlier; null headers are empty, header names are compared
in lower case and the last of equal names counts; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, ship
from ledgerline.llm.ordering import placed, task_of

# Fields that a not-modified answer may update.
PERMITTED = (
    "cache-control",
    "content-location",
    "date",
    "etag",
    "expires",
    "last-modified",
    "vary",
)


def canonical_url(url: Column) -> Column:
    """Without scheme, default port, fragment, tracking fields and closing slashes; host in lower case."""
    bare = F.regexp_replace(url, r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, r"^[^/?]*", 0)
    rest = F.substring(bare, F.length(host) + 1, F.length(bare))
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^?]*", 0), r"/+$", "")
    query = F.regexp_replace(F.regexp_extract(rest, r"\?.*$", 0), r"[?&]utm_[^&]*", "&")
    query = F.regexp_replace(F.regexp_replace(query, r"^[?&]+", "?"), r"[?&]+$", "")
    return F.concat(F.regexp_replace(F.lower(host), r":(80|443)$", ""), path, query)


def _entries(headers: Column) -> Column:
    """Header entries by lower-case name, the last of equal names."""
    entries = F.transform(
        F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>")),
        lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")),
    )
    return F.array_sort(
        F.filter(
            entries,
            lambda e, i: ~F.exists(
                F.filter(entries, lambda _, j: j > i), lambda later: later["key"] == e["key"]
            ),
        )
    )


def _value(entries: Column, name: str) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == name), F.lit(1))["value"]


def _rendered(entries: Column) -> Column:
    lines = F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(lines, "\n")


def _earlier(known: DataFrame) -> DataFrame:
    """url, time and the latest response before, `found`, of each URL and time at which there are records.

    Rows without a found response are left out.
    """
    answer = F.max(F.when(F.col("is_full"), F.struct("at", "record_id", "headers"))).alias("answer")
    moments = known.groupBy(F.col("canonical_url").alias("url"), F.col("at").alias("time")).agg(answer)
    moments = placed(moments, ["url", "time"], ["url", "time", "answer"]).withColumn("task", task_of())
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    near = F.last("answer", ignorenulls=True).over(before("url", "task").orderBy("time"))
    lasts = moments.where(F.col("answer").isNotNull()).groupBy("url", "task").agg(F.max("answer").alias("last"))
    tasks = moments.select("url", "task").distinct().join(lasts, ["url", "task"], "left")
    carried = F.last("last", ignorenulls=True).over(before("url").orderBy("task"))
    carried = tasks.select("url", "task", carried.alias("carried"))
    joined = moments.withColumn("near", near).join(carried, ["url", "task"])
    found = joined.select("url", "time", F.coalesce("near", "carried").alias("found"))
    return found.where(F.col("found").isNotNull())


def resolve(records: DataFrame) -> DataFrame:
    """A row per record: record_id, canonical_url, status, response_id, payload, headers.

    `records`: record_id long, url string, at long, kind (`response` or
    `revisit`), payload string (the body, or its digest or place), headers
    map<string,string>.
    """
    ship(records.sparkSession)
    rows = records.select(
        F.col("record_id").cast("bigint"),
        canonical_url(F.col("url")).alias("canonical_url"),
        F.col("at").cast("bigint"),
        F.coalesce(F.col("kind") == "response", F.lit(False)).alias("is_full"),
        "payload",
        _entries(F.col("headers")).alias("headers"),
    )
    # Without a URL or time nothing is earlier; such records would share a key.
    is_placed = F.col("canonical_url").isNotNull() & F.col("at").isNotNull()
    unplaced = rows.where(~is_placed)
    bodies = rows.where("is_full").select("record_id", "canonical_url", "at", "payload")
    known = rows.where(is_placed).drop("payload")
    found = cut(_earlier(known))
    here = (F.col("canonical_url") == F.col("url")) & (F.col("at") == F.col("time"))
    joined = known.join(found, here, "left").drop("url", "time")
    fields = ["record_id", "canonical_url", "at", "is_full", "headers"]
    kind = joined.schema["found"].dataType

    def agree(name: str) -> Column:
        ours, theirs = _value(F.col("headers"), name), _value(F.col("found.headers"), name)
        return F.regexp_replace(ours, "^W/", "") == F.regexp_replace(theirs, "^W/", "")

    # Null where one side lacks the validator.
    checks = [agree("etag"), agree("last-modified")]
    some = checks[0].isNotNull() | checks[1].isNotNull()
    all_ = F.coalesce(checks[0], F.lit(True)) & F.coalesce(checks[1], F.lit(True))
    status = (
        F.when(F.col("is_full"), "full")
        .when(F.col("found").isNull(), "orphan")
        .when(~some, "unvalidated")
        .when(all_, "resolved")
        .otherwise("mismatch")
    )
    judged = joined.select(*fields, "found").withColumn("status", status)
    # The response whose body a record gets: its own, or the one it is resolved to.
    at = F.when(F.col("is_full"), F.col("at")).when(F.col("status") == "resolved", F.col("found.at"))
    number = F.when(F.col("is_full"), F.col("record_id")).otherwise(F.col("found.record_id"))
    judged = judged.withColumns({"body_at": at, "body_id": number})
    bodies = (
        bodies.where(F.col("canonical_url").isNotNull() & F.col("at").isNotNull())
        .groupBy(F.col("canonical_url").alias("body_url"), F.col("at").alias("own_at"), F.col("record_id").alias("own_id"))
        .agg(F.max("payload").alias("payload"))
    )
    same = (
        (F.col("canonical_url") == F.col("body_url"))
        & (F.col("body_at") == F.col("own_at"))
        & F.col("body_id").eqNullSafe(F.col("own_id"))
    )
    judged = judged.join(bodies, same, "left").select(*fields, "found", "status", "payload")
    judged = judged.union(
        unplaced.withColumn("found", F.lit(None).cast(kind))
        .withColumn("status", F.when(F.col("is_full"), "full").otherwise("orphan"))
        .select(*fields, "found", "status", F.when(F.col("is_full"), F.col("payload")).alias("payload"))
    )
    brought = F.filter("headers", lambda e: e["key"].isin(*PERMITTED))
    stored = F.filter(
        "found.headers", lambda e: ~F.exists(brought, lambda new: new["key"] == e["key"])
    )
    merged = F.array_sort(F.concat(stored, brought))
    return judged.select(
        "record_id",
        "canonical_url",
        "status",
        F.when(~F.col("is_full"), F.col("found.record_id")).alias("response_id"),
        "payload",
        _rendered(F.when(F.col("status") == "resolved", merged).otherwise(F.col("headers"))).alias("headers"),
    )


def crawl_log(pages: DataFrame) -> DataFrame:
    """Records made from a table of pages, bodies as payloads.

    Each page is a full response; every fourth is a version of its host's
    front page, so that such a URL has many responses. Each is revisited
    once later under another spelling of its URL, every third time with a
    stale entity tag; every fifth page is also revisited before it was
    stored. Every seventh page has no entity tag, in either record, and
    every second has a time of modification, the same for 40 pages in a row.
    """
    page = F.col("page_id").cast("bigint")
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    tag = F.when(page % 7 != 3, F.concat(F.lit('"'), F.md5("html"), F.lit('"')))
    rows = pages.select(
        page.alias("page"),
        F.when(page % 4 == 1, host).otherwise(F.col("url")).alias("url"),
        tag.alias("tag"),
        F.when(page % 2 == 0, F.concat(F.lit("day "), F.floor(page / 40).cast("string"))).alias("modified"),
        F.octet_length("html").alias("size"),
        F.col("html").cast("string").alias("body"),
    )

    def headers(**fields: Column) -> Column:
        named = [part for name, value in fields.items() for part in (F.lit(name.replace("_", "-")), value)]
        return F.map_filter(F.create_map(*named), lambda _, value: value.isNotNull())

    def day(at: Column) -> Column:
        return F.concat(F.lit("day "), at.cast("string"))

    response = F.struct(
        (4 * F.col("page")).alias("record_id"),
        F.col("url"),
        (4 * F.col("page")).alias("at"),
        F.lit("response").alias("kind"),
        F.col("body").alias("payload"),
        headers(
            Content_Type=F.lit("text/html"),
            Content_Length=F.col("size").cast("string"),
            ETag=F.col("tag"),
            Last_Modified=F.col("modified"),
            Date=day(4 * F.col("page")),
            Cache_Control=F.lit("max-age=60"),
        ).alias("headers"),
    )

    def revisit(number: int, at: Column, url: Column, tag: Column) -> Column:
        return F.struct(
            (4 * F.col("page") + number).alias("record_id"),
            url.alias("url"),
            at.alias("at"),
            F.lit("revisit").alias("kind"),
            F.lit(None).cast("string").alias("payload"),
            headers(
                Date=day(at),
                ETag=tag,
                Last_Modified=F.col("modified"),
                Cache_Control=F.lit("max-age=120"),
                Content_Length=F.lit("0"),
            ).alias("headers"),
        )

    stale = F.when(F.col("tag").isNotNull() & (F.col("page") % 3 == 0), F.lit('"stale"')).otherwise(F.col("tag"))
    later = revisit(2, 4 * F.col("page") + 2, F.concat(F.col("url"), F.lit("#seen")), F.concat(F.lit("W/"), stale))
    # Asks by time alone: its tag is of a page that was not there yet.
    early = revisit(1, 4 * F.col("page") - 999, F.col("url"), F.when(F.col("page") % 2 == 1, F.col("tag")))
    all_ = F.when(F.col("page") % 5 == 0, F.array(response, later, early)).otherwise(F.array(response, later))
    return rows.select(F.explode(all_).alias("record")).select("record.*")
