"""Not-modified revisits of a web archive: as-of join to the latest earlier full response.

Records: record_id, url, ts, kind ('response' or 'revisit'), etag, last_modified, headers (map). Records are
range partitioned by (canonical URL, time, id) and written once, so a URL with very many captures spreads
over many partitions. Within a partition a window finds the latest earlier response; what a URL's first
partition rows miss is carried over from the partitions before by a table of one row per (partition, URL).
Payloads are not moved: a result names the response record it refers to.

A revisit is 'resolved' where the earlier response's validators agree: an etag given by both must be equal
(weak marks aside), else a last_modified given by both; 'unverified' with no validator in common,
'validator_mismatch' where they differ, 'no_response' where nothing earlier exists. Of equal times the
smaller record_id is the earlier. Null URLs have no earlier response ('no_response'); null times count as the earliest. Repeated
rows each give a row. Empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismdex.llm.common import settle

# Header fields that a not-modified answer may not change.
HELD_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding")
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"


def canonical_url(url: Column) -> Column:
    """Scheme, www., fragment, tracking parameters, default ports and a last slash taken off; host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "(?i)^https?://(www\\.)?", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, "^([^/?]*)", 1), ":(80|443)$", ""))
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    rest = F.regexp_replace(rest, f"([?&]){TRACKING}=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "[?]&+", "?"), "&&+", "&"), "[?&/]+$", "")
    return F.concat(host, rest)


def merged_headers(old: Column, new: Column) -> Column:
    """The response's headers, replaced and extended by the permitted ones of the revisit."""
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    held = F.array(*map(F.lit, HELD_HEADERS))
    allowed = F.map_filter(new, lambda k, v: ~F.array_contains(held, F.lower(k)))
    names = F.transform(F.map_keys(allowed), F.lower)
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(names, F.lower(k))), allowed)


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, canonical, ts, refers_to, refers_ts, status, headers."""
    order = ["ts", "record_id"]
    rows = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), "ts", "kind", "etag", "last_modified", "headers")
    rows = settle(
        rows.repartitionByRange("canonical", *order).withColumn("part", F.spark_partition_id()), "captures")
    full = F.when(F.col("kind") == "response", F.struct(
        F.col("record_id").alias("id"), F.col("ts").alias("at"), "etag", "last_modified", "headers"))
    here = W.partitionBy("part", "canonical").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = rows.withColumn("near", F.when(F.col("canonical").isNotNull(), F.last(full, ignorenulls=True).over(here)))
    # The last response of each URL in each partition, carried to later partitions of the same URL.
    last = rows.where("kind = 'response'").groupBy("part", "canonical").agg(
        F.max_by(F.struct(F.col("record_id").alias("id"), F.col("ts").alias("at"), "etag", "last_modified", "headers"),
                 F.struct(*order)).alias("carried"))
    ends = rows.select("part", "canonical").distinct().join(last, ["part", "canonical"], "left")
    before = W.partitionBy("canonical").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select("part", "canonical", F.last("carried", ignorenulls=True).over(before).alias("carried"))
    found = found.where("kind = 'revisit'").join(
        carry.where("carried is not null"), ["part", "canonical"], "left").withColumn("hit", F.coalesce("near", "carried"))
    strong = lambda c: F.regexp_replace(c, "^W/", "")
    same_tag = strong(F.col("etag")) == strong(F.col("hit.etag"))
    same_date = F.col("last_modified") == F.col("hit.last_modified")
    status = (
        F.when(F.col("hit").isNull(), "no_response")
        .when(~same_tag, "validator_mismatch").when(same_tag, "resolved")
        .when(~same_date, "validator_mismatch").when(same_date, "resolved")
        .otherwise("unverified")
    )
    answered = F.col("status") == "resolved"
    return found.withColumn("status", status).select(
        "record_id", "canonical", "ts",
        F.when(answered, F.col("hit.id")).alias("refers_to"), F.when(answered, F.col("hit.at")).alias("refers_ts"),
        "status", F.when(answered, merged_headers(F.col("hit.headers"), F.col("headers"))).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Records derived from `pages`: each page is a response, and a later visit to it found it not modified.

    The revisit's validator is that of its own page: it agrees with the latest earlier response of the
    canonical URL unless another page has taken the URL meanwhile.
    """
    tag = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    page = pages.select("page_id", "url", tag.alias("etag"), F.length(F.coalesce("html", F.lit(""))).cast("string").alias("size"))
    rows = page.select("url", "etag", F.explode(F.array(
        F.struct((F.col("page_id") * 2).alias("record_id"), (F.col("page_id") * 10).alias("ts"), F.lit("response").alias("kind"),
                 F.create_map(F.lit("Content-Length"), "size", F.lit("Date"), (F.col("page_id") * 10).cast("string")).alias("headers")),
        F.struct((F.col("page_id") * 2 + 1).alias("record_id"), (F.col("page_id") * 10 + 5000).alias("ts"), F.lit("revisit").alias("kind"),
                 F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), (F.col("page_id") * 10 + 5000).cast("string")).alias("headers")),
    )).alias("r"))
    return rows.select("url", "etag", F.lit(None).cast("string").alias("last_modified"), "r.*")


def op8_revisit(pages: DataFrame) -> DataFrame:
    """Every revisit derived from `pages`; refers_to and refers_ts are -1 where it is not resolved."""
    get = lambda name: F.try_element_at("headers", F.lit(name))
    return resolve(captures(pages)).select(
        "record_id", "canonical", "ts", F.coalesce("refers_to", F.lit(-1)).alias("refers_to"),
        F.coalesce("refers_ts", F.lit(-1)).alias("refers_ts"), "status",
        get("Content-Length").alias("content_length"), get("date").alias("date"))


ORACLE_SQL = r"""
WITH page AS (
  SELECT page_id, md5(coalesce(html, '')) AS etag, length(coalesce(html, ''))::VARCHAR AS size,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^https?://(www\.)?', '', 'i') AS bare
  FROM pages),
split AS (
  SELECT *, lower(regexp_replace(regexp_extract(bare, '^([^/?]*)', 1), ':(80|443)$', '')) AS host,
         regexp_replace(regexp_replace(bare, '^[^/?]*', ''), '([?&])(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\1', 'g') AS rest
  FROM page),
urls AS (
  SELECT page_id, etag, size, host || regexp_replace(regexp_replace(regexp_replace(rest, '[?]&+', '?', 'g'), '&&+', '&', 'g'), '[?&/]+$', '') AS canonical
  FROM split),
best AS (
  SELECT v.page_id * 2 + 1 AS record_id, v.canonical, v.page_id * 10 + 5000 AS ts, v.etag,
         arg_max(r.etag, r.page_id) AS old_tag, max(r.page_id) AS old_page, arg_max(r.size, r.page_id) AS size
  FROM urls v LEFT JOIN urls r ON r.canonical = v.canonical
       AND (r.page_id * 10 < v.page_id * 10 + 5000 OR (r.page_id * 10 = v.page_id * 10 + 5000 AND r.page_id * 2 < v.page_id * 2 + 1))
  GROUP BY ALL)
SELECT record_id, canonical, ts,
       CASE WHEN etag = old_tag THEN old_page * 2 ELSE -1 END AS refers_to,
       CASE WHEN etag = old_tag THEN old_page * 10 ELSE -1 END AS refers_ts,
       CASE WHEN old_page IS NULL THEN 'no_response' WHEN etag = old_tag THEN 'resolved' ELSE 'validator_mismatch' END AS status,
       CASE WHEN etag = old_tag THEN size END AS content_length,
       CASE WHEN etag = old_tag THEN ts::VARCHAR END AS date
FROM best
"""
