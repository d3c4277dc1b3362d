"""Not-modified revisit resolution over crawl records (WARC).

A *not modified* record (a ``revisit``, HTTP 304) has no payload; what it stands for is the latest earlier full response
of the same canonical URL. ``resolve`` finds it by an as-of join, checks the validators (entity tag, else last-modified
date, else payload digest), and merges the headers that a 304 may update into those of the stored response.

The as-of join sorts records by canonical URL and time over range partitions, carries the last full response forward
within each partition, and then over the partitions of one URL (one row for each). A URL with a third of all records is
spread over as many partitions as it fills.

Defined results: records without a usable URL (null or empty) are never resolved (``no-url``); of records with equal
time the smaller record_id comes first; a null time comes before all others; a revisit without an earlier full response
is ``no-response``; one whose validators disagree with it, or that has none in common with it, is ``mismatch`` and gets
no headers. Rows that repeat a record are resolved one by one. Null headers count as none. A null kind is a full record
that lends nothing. Other columns are ignored.

URLs are one resource if they agree but for scheme, letter case of the host, ``www.``, the scheme's own port, a fragment,
the order of parameters and parameters that only track; path and parameters keep their case and their slashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import keep

#: Header fields that a 304 response may update (RFC 9110, 15.4.5), in lower case.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that don't change what is fetched.
TRACKING = ("utm_[a-z]+", "fbclid", "gclid")
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path (``/`` if empty) and parameters; null if there is no host.

    Parameters are sorted by name; those of one name keep their order, which may matter to who reads them.
    """
    whole = F.regexp_replace(F.trim(url), r"#.*$", "")
    secure = F.rlike(whole, F.lit("^(?i)https://"))
    rest = F.regexp_replace(whole, _SCHEME, "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^www\.", "")
    host = F.when(secure, F.regexp_replace(host, ":443$", "")).otherwise(F.regexp_replace(host, ":80$", ""))
    tail = F.regexp_replace(rest, r"^[^/?]*", "")
    path = F.regexp_extract(tail, r"^[^?]*", 0)
    parameters = F.split(F.regexp_replace(tail, r"^[^?]*\??", ""), "&")
    parameters = F.filter(parameters, lambda x: (x != "") & ~F.rlike(x, F.lit(rf"^({'|'.join(TRACKING)})=")))
    named = F.transform(parameters, lambda x, at: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("name"), at.alias("at"), x.alias("whole")))
    parameters = F.transform(F.array_sort(named), lambda x: x["whole"])
    query = F.when(F.size(parameters) > 0, F.concat(F.lit("?"), F.array_join(parameters, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), query))


def as_of(records: DataFrame, key: str, order: list[str], value: Column, name: str = "before") -> DataFrame:
    """``records`` with ``name``: the last non-null ``value`` of an earlier row of the same ``key``.

    Rows of one key may fill any number of partitions.
    """
    rows = records.withColumn("_value", value).repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id())
    rows = keep(rows, "as-of")
    inside = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = rows.where("_value is not null").groupBy(key, "_part").agg(F.max_by("_value", F.struct(*order)).alias("_last"))
    parts = rows.select(key, "_part").distinct().join(last, [key, "_part"], "left")
    over = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("_carried", F.last("_last", ignorenulls=True).over(over)).where("_carried is not null").select(key, "_part", "_carried")
    local = rows.withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
    return local.join(carried, [key, "_part"], "left").withColumn(name, F.coalesce("_local", "_carried")).drop("_value", "_part", "_local", "_carried")


def merged_headers(stored: Column, fresh: Column, permitted: tuple[str, ...] = PERMITTED) -> Column:
    """``stored`` with the permitted fields of ``fresh`` (maps; field names compared in lower case)."""
    lower = lambda m: F.transform_keys(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    new = F.map_filter(lower(fresh), lambda k, v: k.isin(*permitted) & v.isNotNull())
    old = F.map_filter(lower(stored), lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(old, new)


def resolve(records: DataFrame, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """Every record with its resolution.

    ``records``: record_id, url, time, kind (``response`` or ``revisit``), etag, last_modified, digest (strings, null
    where absent), headers (map). Returns record_id, canonical, kind, status, refers_to, validator, headers. status of a
    revisit: ``resolved``, ``mismatch``, ``no-response`` or ``no-url``; of any other record ``full``. Headers of a
    resolved revisit are the merged ones; of a full response its own.
    """
    slim = records.select("record_id", "time", "kind", "etag", "last_modified", "digest", "headers", canonical_url(F.col("url")).alias("canonical"))
    full = F.when(F.col("kind") == "response", F.struct("record_id", "etag", "last_modified", "digest", "headers"))
    known = as_of(slim.where("canonical is not null"), "canonical", ["time", "record_id"], full)
    none = slim.where("canonical is null").withColumn("before", F.lit(None).cast(known.schema["before"].dataType))
    rows = known.unionByName(none)
    both = lambda f: F.col(f).isNotNull() & F.col(f"before.{f}").isNotNull()
    strong = lambda c: F.regexp_replace(c, "^W/", "")
    validator = F.when(both("etag"), "etag").when(both("last_modified"), "last-modified").when(both("digest"), "digest")
    agree = (
        F.when(F.col("validator") == "etag", strong(F.col("etag")) == strong(F.col("before.etag")))
        .when(F.col("validator") == "last-modified", F.col("last_modified") == F.col("before.last_modified"))
        .when(F.col("validator") == "digest", F.col("digest") == F.col("before.digest"))
        .otherwise(False)
    )
    revisit = F.col("kind") == "revisit"
    status = F.when(~F.coalesce(revisit, F.lit(False)), "full").when(F.col("canonical").isNull(), "no-url").when(F.col("before").isNull(), "no-response").when(agree, "resolved").otherwise("mismatch")
    rows = rows.withColumn("validator", F.when(revisit, validator)).withColumn("status", status)
    headers = F.when(F.col("status") == "resolved", merged_headers(F.col("before.headers"), F.col("headers"), permitted)).when(F.col("status") == "full", F.col("headers"))
    return rows.select("record_id", "canonical", "kind", "status", F.when(F.col("status").isin("resolved", "mismatch"), F.col("before.record_id")).alias("refers_to"), "validator", headers.alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Five crawl records of each page (page_id, url, html): a full response and later visits under other spellings.

    The second is a revisit with the right entity tag; the third one with a last-modified date, or, for every fifth page,
    an entity tag that is out of date; the fourth, with the host in capitals, is, for every fourth page, a new full
    response, else a revisit by payload digest; the fifth asks for the path in capitals, which is another resource.
    """
    p, k = F.col("page_id"), F.col("k")
    joined = F.when(F.contains("url", F.lit("?")), "&").otherwise("?")
    host, rest = F.regexp_extract("url", r"^[a-z]+://[^/?#]*", 0), F.regexp_replace("url", r"^[a-z]+://[^/?#]*", "")
    spelled = (
        F.when(k == 1, F.concat(F.regexp_replace("url", "#.*$", ""), joined, F.lit("utm_medium=mail"))).when(k == 2, F.replace(F.col("url"), F.lit("http://"), F.lit("https://")))
        .when(k == 3, F.concat(F.upper(host), rest)).when(k == 4, F.concat(host, F.upper(rest))).otherwise(F.col("url"))
    )
    full = (k == 0) | ((k == 3) & (p % 4 == 0))
    digest = F.md5("html")
    etag = F.when(k.isin(0, 1, 4), F.substring("digest", 1, 12)).when(full, F.lit("v2")).when((k == 2) & (p % 5 == 0), F.lit("old"))
    modified = F.concat(F.lit("day "), (p % 400).cast("string"))
    slim = pages.select("page_id", "url", digest.alias("digest")).withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(5)])))
    headers = F.when(full, F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), p.cast("string"), F.lit("server"), F.lit("a")))
    later = F.create_map(F.lit("Date"), (p + k).cast("string"), F.lit("Expires"), k.cast("string"), F.lit("Server"), F.lit("b"))
    return slim.select(
        (p * 5 + k).alias("record_id"), spelled.alias("url"), (p + k * 7).alias("time"), F.when(full, "response").otherwise("revisit").alias("kind"), etag.alias("etag"),
        F.when(full | (k == 2), modified).alias("last_modified"), F.when(full | (k == 3), F.col("digest")).alias("digest"), F.coalesce(headers, later).alias("headers"),
    )
