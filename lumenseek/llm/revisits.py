"""Resolution of not-modified revisits in web archives.

A revisit record of the profile "server not modified" has the headers of a 304
answer and no payload. It stands for the latest full response of the same
canonical URL that was captured strictly earlier. That response is found by an
as-of join, the validators of both are compared, and the headers that a 304 may
change are laid over those of the response.

Records: ``record_id``, ``kind`` (response or revisit), ``url``, ``at`` (long, any
unit), ``status``, ``headers`` (map of lower-case names) and ``digest`` of the
payload. The as-of join never sorts a URL as a whole: times are cut into ranges by
quantiles; the last response of each URL in each range is an aggregate that
combines in the map tasks, the last one before a range is carried over those few
rows, and records are only ordered inside a URL's range.

Verdicts: ``resolved`` (a validator that both have agrees: ETag by weak comparison,
else Last-Modified), ``stale`` (it differs), ``unvalidated`` (they share none),
``no_response`` (none is earlier). Full responses have status 200; of several at
one time the largest ``record_id`` counts as the latest. Null URLs are one URL of
their own that never resolves; records with a null time are no response and
resolve to none; null headers are no headers. Repeated records count as often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenseek.llm.common import bind

#: Headers of a 304 answer that replace those of the stored response (RFC 9110, 15.4.5).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
#: Query parameters that do not select content.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
#: Records of a time range, on average, and the most ranges.
RANGE_ROWS, MAX_RANGES = 4096, 4096


def canonical(url: Column) -> Column:
    """Host in lower case without ``www.``, path without closing slashes, sorted parameters without tracking ones."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    base = F.regexp_extract(plain, r"^([^?]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(base, "^([^/]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(base, "^[^/]*(.*)$", 1), "/+$", "")
    query = F.split(F.regexp_extract(plain, r"^[^?]*\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _opaque(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: ``record_id``, ``url_key``, ``base_id``, ``verdict``, merged ``headers`` and ``digest``."""
    many = max(1, min(MAX_RANGES, -(-records.count() // RANGE_ROWS)))
    cuts = [k / many for k in range(1, many)]
    bounds = sorted(set((records.agg(F.percentile_approx("at", cuts, 100 * many).alias("b")).first()[0] if cuts else None) or []))
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>") if bounds else None
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))]) if bounds else None
    # The time comes in as a lambda variable. Spark compares expressions with lambda variables numbered from 0 and takes a column
    # of the same number, named inside a lambda, for one of them: the join by span then filters one side by a column it lacks.
    span = bind(F.col("at"), lambda at: F.aggregate(steps, F.lit(0), lambda i, s: F.when(
        F.coalesce(F.get(table, i + s - 1) < at, F.lit(False)), i + s).otherwise(i))) if bounds else F.lit(0)
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("at").isNotNull()
    rows = records.select("record_id", "kind", F.coalesce(canonical(F.col("url")), F.lit("")).alias("url_key"), "at",
                          span.alias("span"), F.coalesce("headers", F.expr("cast(map() as map<string,string>)")).alias("headers"),
                          "digest", full.alias("full"), F.col("url").isNotNull().alias("named"))
    base = F.struct("at", F.col("record_id").alias("id"), F.map_entries("headers").alias("headers"), "digest")
    rows = rows.where("full or kind = 'revisit'").withColumn("base", F.when(F.col("full") & F.col("named"), base))
    latest = rows.groupBy("url_key", "span").agg(F.max_by("base", F.when(F.col("base").isNotNull(), F.struct("at", "record_id")))
                                                 .alias("latest"))
    before = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select("url_key", "span", F.last("latest", True).over(before).alias("carried"))
    # Earlier means a smaller time, so the frame is one of values; equal times see the same base.
    inside = Window.partitionBy("url_key", "span").orderBy(F.col("at")).rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("inside", F.max("base").over(inside))
    found = near.where("kind = 'revisit'").join(carried, ["url_key", "span"])
    found = found.withColumn("b", F.when(F.col("named") & F.col("at").isNotNull(), F.coalesce("inside", "carried")))
    stored = F.map_from_entries(F.coalesce("b.headers", F.expr("cast(array() as array<struct<key:string,value:string>>)")))
    found = found.withColumn("stored", stored)
    tags, dates = (F.element_at("headers", "etag"), F.element_at("stored", "etag")), \
        (F.element_at("headers", "last-modified"), F.element_at("stored", "last-modified"))
    verdict = (F.when(F.col("b").isNull(), "no_response")
               .when(_opaque(tags[0]) == _opaque(tags[1]), "resolved").when(tags[0].isNotNull() & tags[1].isNotNull(), "stale")
               .when(dates[0] == dates[1], "resolved").when(dates[0].isNotNull() & dates[1].isNotNull(), "stale")
               .otherwise("unvalidated"))
    allowed = F.map_filter("headers", lambda k, v: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.map_contains_key(allowed, k)), allowed)
    resolved = F.col("verdict") == "resolved"
    return found.withColumn("verdict", verdict).select(
        "record_id", "url_key", F.col("b.id").alias("base_id"), "verdict", F.when(resolved, merged).alias("headers"),
        F.when(resolved, F.col("b.digest")).alias("digest"))


def captures(pages: DataFrame) -> DataFrame:
    """Archive records of ``pages``: a full response of each, and one conditional request.

    The response is captured at minute ``page_id``. The conditional request uses
    the validators of that page: a weak ETag, but for mobile hosts, which send
    Last-Modified only; ``.html`` pages are asked for without validators. Requests
    for URLs with a fragment are made just before the response, all others after
    all responses, so a later page of the same URL makes them stale.
    """
    minute = F.col("page_id") * 60
    tag, day = F.md5(F.col("html")), F.date_format(F.timestamp_seconds(minute), "yyyy-MM-dd HH:mm:ss")
    mobile, bare = F.col("url").rlike("^https?://m[.]"), F.col("url").rlike("[.]html$")
    nothing = F.lit(None).cast("string")

    def headers(**values: Column) -> Column:
        pairs = F.array(*[F.struct(F.lit(k.replace("_", "-")).alias("key"), v.alias("value")) for k, v in values.items()])
        return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))

    full = pages.select((F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", minute.alias("at"),
                        F.lit(200).alias("status"), headers(
        cache_control=F.lit("max-age=3600"), content_length=F.octet_length("html").cast("string"),
        content_type=F.lit("text/html"), date=day, etag=F.when(~mobile, F.concat(F.lit('"'), tag, F.lit('"'))),
        last_modified=day).alias("headers"), F.sha2("html", 256).alias("digest"))
    asked = F.when(F.col("url").contains("#"), minute - 30).otherwise(minute + 10 ** 12)
    again = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", asked.alias("at"),
                         F.lit(304).alias("status"), headers(
        cache_control=F.lit("max-age=60"), content_length=F.lit("0"), date=asked.cast("string"),
        etag=F.when(~mobile & ~bare, F.concat(F.lit('W/"'), tag, F.lit('"'))), last_modified=F.when(mobile & ~bare, day),
        server=F.lit("cache")).alias("headers"), nothing.alias("digest"))
    return full.union(again)


def op6_revisits(pages: DataFrame) -> DataFrame:
    """The conditional request of every page, resolved."""
    out = resolve(captures(pages))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.select((F.floor(F.col("record_id") / 2)).alias("page_id"), "url_key", F.floor(F.col("base_id") / 2).alias("base_page_id"),
                      "verdict", text.alias("headers"), "digest")


#: DuckDB: the same as an as-of join.
OP6_SQL = r"""
WITH p AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS plain,
    md5(html) AS tag, strftime(make_timestamp(page_id * 60000000), '%Y-%m-%d %H:%M:%S') AS day,
    regexp_matches(url, '^https?://m[.]') AS mobile, regexp_matches(url, '[.]html$') AS bare FROM pages),
k AS (
  SELECT *, regexp_replace(lower(regexp_extract(plain, '^([^/?]*)', 1)), '^www\.|:(80|443)$', '', 'g')
    || regexp_replace(regexp_extract(regexp_extract(plain, '^([^?]*)', 1), '^[^/]*(.*)$', 1), '/+$', '') AS base,
    list_sort([x FOR x IN string_split(regexp_extract(plain, '^[^?]*\?(.*)$', 1), '&')
      IF x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')]) AS q FROM p),
u AS (
  SELECT *, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key,
    CASE WHEN contains(url, '#') THEN page_id * 60 - 30 ELSE page_id * 60 + 1000000000000 END AS asked FROM k),
j AS (
  SELECT a.*, b.page_id AS base_page_id, b.tag AS b_tag, b.day AS b_day, b.mobile AS b_mobile, b.html AS b_html
  FROM u a ASOF LEFT JOIN (SELECT *, page_id * 60 AS got FROM u) b ON a.url_key = b.url_key AND a.asked > b.got),
v AS (
  SELECT *, CASE WHEN base_page_id IS NULL THEN 'no_response'
    WHEN NOT mobile AND NOT bare AND NOT b_mobile THEN CASE WHEN tag = b_tag THEN 'resolved' ELSE 'stale' END
    WHEN mobile AND NOT bare THEN CASE WHEN day = b_day THEN 'resolved' ELSE 'stale' END
    ELSE 'unvalidated' END AS verdict FROM j)
SELECT page_id, url_key, base_page_id, verdict,
  CASE WHEN verdict = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || strlen(b_html) || chr(10)
    || 'content-type: text/html' || chr(10) || 'date: ' || asked
    || CASE WHEN NOT mobile THEN chr(10) || 'etag: W/"' || tag || '"' WHEN NOT b_mobile THEN chr(10) || 'etag: "' || b_tag || '"'
       ELSE '' END || chr(10) || 'last-modified: ' || b_day END AS headers,
  CASE WHEN verdict = 'resolved' THEN sha256(b_html) END AS digest
FROM v
"""
