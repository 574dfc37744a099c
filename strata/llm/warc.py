"""Resolving not-modified revisit records of web archives.

A revisit record (HTTP 304, or an identical payload) has no payload of its own: it stands for the latest earlier full response
of the same canonical URL. The as-of join runs on ranges of (URL, time): rows are range-partitioned, so that a URL with very
many captures is cut over many partitions; each range carries its last full response forward by itself, and the last response of
earlier ranges of the same URL comes in as one more row in front of the range. Nothing is broadcast. The match is then checked against
the revisit's validators, and the headers that a 304 may change are merged into those of the response.

Earlier means a smaller time, or the same time and a smaller record id. Rows with a null URL, time or id take no part as
responses; such revisits come out with `no_response`. Repeated rows are resolved each on its own. Header names are compared
without regard to case; null headers count as none. Extra columns are dropped. An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm._common import stored

#: Query parameters that don't change the page, and host prefixes of the same site.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"
PREFIXES = r"^(www|m)\."
#: Headers of a 304 that never change the stored response: they describe the message or the payload.
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. or m. and default port, path without a last slash, and sorted query without tracking."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), PREFIXES, ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that differ by case alone, the last value by name and value stays."""
    none = F.create_map().cast("map<string,string>")
    entries = F.array_sort(F.map_entries(F.coalesce(headers, none)))
    return F.aggregate(entries, none, lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])))


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers with those of the revisit that may change them; both with names in lower case."""
    allowed = F.map_filter(revisit, lambda k, _: ~k.isin(*NOT_MERGED))
    return F.map_concat(F.map_filter(response, lambda k, _: ~F.map_contains_key(allowed, k)), allowed)


def _etag(headers: Column) -> Column:
    """For weak comparison."""
    return F.regexp_replace(F.trim(headers["etag"]), "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """record_id, canonical_url, ts, refers_to, outcome, status and headers for each revisit of records.

    records: record_id long, url string, ts long or timestamp, type string (`response` or `revisit`), status int,
    payload_digest string, headers map<string,string>. A full response has a status from 200 to 299 but 206.
    outcome: `resolved` (refers_to, the response's status and merged headers are given), `digest_mismatch`, `etag_mismatch`,
    `modified` (Last-Modified differs) or `unvalidated` (no validator in common): refers_to alone is given; `no_response`.
    A digest on both sides decides; else an ETag on both; else Last-Modified."""
    full = (F.col("type") == "response") & F.col("status").between(200, 299) & (F.col("status") != 206) & F.col("ts").isNotNull() & F.col("record_id").isNotNull() & F.col("url").isNotNull()
    slim = records.where(full | (F.col("type") == "revisit")).select(
        canonical_url(F.col("url")).alias("canonical_url"), "ts", "record_id", "payload_digest", lower_names(F.col("headers")).alias("headers"), "status", full.alias("full")
    )
    response = F.when(F.col("full"), F.struct("record_id", "status", "payload_digest", "headers"))
    dealt = stored(slim.repartitionByRange("canonical_url", "ts", "record_id").withColumns({"response": response, "part": F.spark_partition_id()}), "records")

    # From earlier ranges of the same URL: only a range's first URL can have begun before it.
    ranges = dealt.groupBy("canonical_url", "part").agg(F.max_by("response", F.when(F.col("full"), F.struct("ts", "record_id"))).alias("last"))
    earlier = Window.partitionBy("canonical_url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.withColumn("response", F.last("last", ignorenulls=True).over(earlier)).where(F.col("response").isNotNull()).select("canonical_url", "part", "response", F.lit(0).alias("place"))

    # Within a range: the last full response before each row.
    order = ("place", F.col("ts").asc_nulls_first(), F.col("record_id").asc_nulls_first(), F.col("full").desc())
    before = Window.partitionBy("canonical_url", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    led = dealt.withColumn("place", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    joined = led.withColumn("found", F.last("response", ignorenulls=True).over(before)).where((F.col("place") == 1) & ~F.col("full"))
    match = F.when(F.col("ts").isNotNull() & F.col("record_id").isNotNull(), F.col("found"))
    rows = joined.withColumn("match", match)
    m, h = F.col("match"), F.col("headers")
    digests = F.col("payload_digest").isNotNull() & m["payload_digest"].isNotNull()
    etags = h["etag"].isNotNull() & m["headers"]["etag"].isNotNull()
    dates = h["last-modified"].isNotNull() & m["headers"]["last-modified"].isNotNull()
    outcome = (
        F.when(m.isNull(), "no_response")
        .when(digests, F.when(F.col("payload_digest") == m["payload_digest"], "resolved").otherwise("digest_mismatch"))
        .when(etags, F.when(_etag(h) == _etag(m["headers"]), "resolved").otherwise("etag_mismatch"))
        .when(dates, F.when(h["last-modified"] == m["headers"]["last-modified"], "resolved").otherwise("modified"))
        .otherwise("unvalidated")
    )
    done = F.col("outcome") == "resolved"
    return rows.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "ts", m["record_id"].alias("refers_to"), "outcome", F.when(done, m["status"]).alias("status"), F.when(done, merged_headers(m["headers"], h)).alias("headers")
    )


def header_lines(headers: Column) -> Column:
    """`name: value` lines in order of name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


#: The recrawl asks for each page again this many ticks after its capture.
RECRAWL_AFTER = 1000


def crawl_records(pages: DataFrame) -> DataFrame:
    """A crawl's records: each page is a full response at tick page_id, with an ETag from its payload; a recrawl asks for each
    page again RECRAWL_AFTER ticks later and gets a not-modified record with the page's ETag."""
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    etag = F.concat(F.lit('"'), digest, F.lit('"'))
    none = F.lit(None).cast("string")
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("ts"), F.lit("response").alias("type"), F.lit(200).alias("status"), none.alias("payload_digest"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("ETag"), etag, F.lit("Date"), F.col("page_id").cast("string")).alias("headers"),
    )
    later = F.col("page_id") + RECRAWL_AFTER
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", later.alias("ts"), F.lit("revisit").alias("type"), F.lit(304).alias("status"), none.alias("payload_digest"),
        F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("ETag"), F.concat(F.lit("W/"), etag), F.lit("Date"), later.cast("string"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
    )
    return response.unionByName(revisit)


ORACLE = r"""
WITH urls AS (
  SELECT page_id, md5(coalesce(html, '')) AS tag, strlen(coalesce(html, '')) AS size, url,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS rest
  FROM pages
), parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^(www|m)\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))), '&') AS query
  FROM urls
), canonical AS (
  SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical_url FROM parts
), asked AS (
  SELECT r.page_id, r.tag, r.canonical_url, max(f.page_id) AS found
  FROM canonical r LEFT JOIN canonical f
    ON f.canonical_url = r.canonical_url AND (f.page_id < r.page_id + 1000 OR (f.page_id = r.page_id + 1000 AND f.page_id * 2 < r.page_id * 2 + 1))
  GROUP BY ALL
)
SELECT a.page_id * 2 + 1 AS record_id, a.canonical_url, a.page_id + 1000 AS ts, a.found * 2 AS refers_to,
       CASE WHEN a.found IS NULL THEN 'no_response' WHEN a.tag = f.tag THEN 'resolved' ELSE 'etag_mismatch' END AS outcome,
       CASE WHEN a.tag = f.tag THEN 200 END AS status,
       CASE WHEN a.tag = f.tag THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || f.size || chr(10) || 'content-type: text/html'
         || chr(10) || 'date: ' || (a.page_id + 1000) || chr(10) || 'etag: W/"' || a.tag || '"' END AS header_lines
FROM asked a LEFT JOIN canonical f ON f.page_id = a.found
"""
