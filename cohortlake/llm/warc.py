"""Not-modified revisit resolution over web archive records.

A revisit record (an HTTP 304 capture) is joined as-of by canonical URL to the
latest earlier full response, validators are compared, and the headers that a
304 may update are merged into the stored ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SLICES = 64
#: Headers of a 304 that never replace the stored response's.
FORBIDDEN = ["content-encoding", "content-length", "content-range", "content-type", "trailer", "transfer-encoding"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(url: Column) -> Column:
    """A key for urls of one resource: no scheme, ASCII-lower-case host without
    default port, no fragment, no ``utm_`` parameters, the others in order, no
    trailing slash. Null for null; a url without ``://`` stands for itself."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.translate(F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r":(80|443)$", ""), UPPER, LOWER)
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    return F.when(url.contains("://"), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))).otherwise(url)


def _plain(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def merge_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers updated by the permitted ones of the 304 (names in lower case)."""
    allowed = F.map_filter(F.coalesce(fresh, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(FORBIDDEN))
    kept = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(kept, allowed)


def resolve_revisits(records: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per revisit of ``records``: record_id, url_key, response_id, status, headers.

    records: record_id (long), kind ('response' or 'revisit'), url, ts (long),
    etag, last_modified, headers (map, names in lower case). Other columns are
    ignored. The response is the latest of an earlier ts (ties: larger
    record_id); responses without url or ts take no part. status: 'resolved',
    'validator_mismatch', 'no_validator' (neither etag nor last_modified on
    both sides; etags win, weakly compared), 'no_earlier_response' (also for a
    revisit without url or ts). Headers are merged where it is resolved, else
    the revisit's own; response_id is null only if there is no earlier response.

    A url with many captures is cut into time slices, each starting from the
    last response of the slices before it, so no url lands in one task.
    """
    rows = records.select("record_id", "kind", canonical(F.col("url")).alias("url_key"), "ts", "etag", "last_modified", "headers")
    placed = rows.where("url_key is not null and ts is not null")
    edges = placed.agg(F.percentile_approx("ts", F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)]), 10_000)).first()[0] or []
    cut = F.lit(0)
    for e in sorted(set(edges)):
        cut = cut + (F.col("ts") > e).cast("int")
    kept = F.struct("ts", F.col("record_id").alias("id"), "etag", "last_modified", "headers")
    order = F.struct("ts", "record_id")
    placed = placed.withColumn("slice", cut)
    lasts = placed.where("kind = 'response'").groupBy("url_key", "slice").agg(F.max_by(kept, order).alias("last"))
    lasts = scratch.table(lasts)
    # the last response of all earlier slices, for the slices that hold revisits
    asked = placed.where("kind = 'revisit'").select("url_key", "slice").distinct()
    steps = asked.withColumn("last", F.lit(None).cast(lasts.schema["last"].dataType)).withColumn("asks", F.lit(0)).unionByName(lasts.withColumn("asks", F.lit(1)))
    carried = steps.withColumn("carry", F.last("last", ignorenulls=True).over(Window.partitionBy("url_key").orderBy("slice", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("asks = 0").select("url_key", "slice", "carry")
    within = Window.partitionBy("url_key", "slice").orderBy("ts", F.col("kind") != "revisit", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = placed.withColumn("near", F.last(F.when(F.col("kind") == "response", kept), ignorenulls=True).over(within)).where("kind = 'revisit'")
    found = seen.join(scratch.table(carried), ["url_key", "slice"], "left").withColumn("base", F.coalesce("near", "carry")).drop("near", "carry", "slice")
    lost = rows.where("kind = 'revisit' and (url_key is null or ts is null)").withColumn("base", F.lit(None).cast(found.schema["base"].dataType))
    out = found.unionByName(lost.select(*found.columns))
    same = F.when(F.col("etag").isNotNull() & F.col("base.etag").isNotNull(), _plain(F.col("etag")) == _plain(F.col("base.etag"))).when(F.col("last_modified").isNotNull() & F.col("base.last_modified").isNotNull(), F.col("last_modified") == F.col("base.last_modified"))
    status = F.when(F.col("base").isNull(), "no_earlier_response").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("validator_mismatch")
    return out.select("record_id", "url_key", F.col("base.id").alias("response_id"), status.alias("status"), F.when(status == "resolved", merge_headers(F.col("base.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"))


def page_records(pages: DataFrame, later: int = 40) -> DataFrame:
    """Every page as a response at time 10 * page_id, and as a revisit ``later``
    pages afterwards whose etag is the page's own (every fifth has a weak one,
    every seventh none but a date)."""
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.col("html").cast("binary")), 1, 16), F.lit('"'))
    id_ = F.col("page_id")
    date = F.concat(F.lit("day "), F.col("page_id").cast("string"))
    pair = lambda k, v: F.create_map(F.lit(k), v.cast("string"))
    response = pages.select((id_ * 2).alias("record_id"), F.lit("response").alias("kind"), "url", (id_ * 10).alias("ts"), tag.alias("etag"), date.alias("last_modified"), F.map_concat(pair("content-type", F.lit("text/html")), pair("content-length", F.octet_length("html")), pair("cache-control", F.lit("max-age=60")), pair("date", id_)).alias("headers"))
    weak = F.when(id_ % 7 == 0, F.lit(None)).when(id_ % 5 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    revisit = pages.select((id_ * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", ((id_ + later) * 10 + 5).alias("ts"), weak.alias("etag"), date.alias("last_modified"), F.map_concat(pair("content-length", F.lit("0")), pair("cache-control", F.lit("max-age=0")), pair("date", id_ + later)).alias("headers"))
    return response.unionByName(revisit)


def op7(spark, sf_dir: str) -> DataFrame:
    """Revisits of all pages; headers as sorted ``name: value`` lines."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = resolve_revisits(page_records(pages), Scratch(spark, "op7"))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))), "\n")
    return out.select("record_id", "url_key", "response_id", "status", lines.alias("headers"))


ORACLE = """
WITH base AS (
  SELECT page_id, url, '"' || substr(md5(html), 1, 16) || '"' AS tag, strlen(html) AS size,
    regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest FROM pages),
parts AS (
  SELECT *, regexp_replace(regexp_extract(rest, '^([^/?]*)', 1), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))), '&') AS query FROM base),
keyed AS (
  SELECT page_id, tag, size, CASE WHEN contains(url, '://') THEN translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END ELSE url END AS url_key FROM parts),
revisits AS (
  SELECT page_id * 2 + 1 AS record_id, url_key, (page_id + 40) * 10 + 5 AS ts, page_id,
    CASE WHEN page_id % 7 = 0 THEN NULL ELSE tag END AS tag FROM keyed),
joined AS (
  SELECT r.record_id, r.url_key, r.page_id, r.tag, k.page_id AS found, k.tag AS stored, k.size
  FROM revisits r ASOF LEFT JOIN keyed k ON r.url_key = k.url_key AND r.ts > k.page_id * 10),
judged AS (
  SELECT *, CASE WHEN found IS NULL THEN 'no_earlier_response'
    WHEN tag IS NOT NULL AND stored IS NOT NULL THEN CASE WHEN tag = stored THEN 'resolved' ELSE 'validator_mismatch' END
    ELSE CASE WHEN found = page_id THEN 'resolved' ELSE 'validator_mismatch' END END AS status FROM joined)
SELECT record_id, url_key, found * 2 AS response_id, status,
  'cache-control: max-age=0' || chr(10) || CASE WHEN status = 'resolved'
    THEN 'content-length: ' || size || chr(10) || 'content-type: text/html' ELSE 'content-length: 0' END
  || chr(10) || 'date: ' || (page_id + 40) AS headers
FROM judged
"""
