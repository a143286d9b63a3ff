"""Not-modified revisit resolution of WARC captures (operator 10).

A capture is (id, url, time, status, headers, body digest). A full response has status 200 and a body; a
revisit has status 304 and no body. Every revisit is joined with the latest full response of the same
canonical URL that is earlier (of several at one time the one with the largest id), and takes its body
when the validators agree: by entity tag if both sides have one (a weak mark does not count), else
by Last-Modified if both have it. Headers that a 304 may update replace the stored ones, others stay.

State of a revisit: ``resolved``; ``mismatch`` if the validators differ; ``unverified`` if there is none
in common; ``orphan`` without an earlier response, or with a null URL or time. Other captures are
``response`` or ``other`` and keep what they have.

As-of join without one long task: captures of a URL are cut by hour. Inside an hour the last response is
carried forward; each (URL, hour) hands over its last response, one row, and these are carried over
hours. A URL with a third of all captures is thus spread over its hours, and only one row for each of
them meets in one task; captures without a URL or time are spread by id. Rows that repeat an id are captures each by itself. An empty table gives
no row.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

# Fields of a 304 response that replace the stored ones (RFC 9110, 15.4.5; RFC 9111, 3.2).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Parameters that name no other page.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def canonical_url(url):
    """The URL by which captures are compared: scheme and user left out, host in lower case without a
    leading ``www.`` and without a default port, no fragment, no tracking parameters, the others
    sorted, no slash at the end of the path. Null without ``://``."""
    rest = F.regexp_replace(F.regexp_extract(url, "(?s)://(.*)$", 1), "(?s)#.*$", "")
    place = F.regexp_extract(rest, r"^([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(place), "^.*@", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"(?s)\?(.*)$", 1)
    kept = F.array_sort(F.filter(
        F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?i:{TRACKING})(=|$)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.contains(url, F.lit("://")), F.concat(F.regexp_replace(host, r"^www\.", ""), path, tail))


def validator(headers, name):
    """A header that says which version a body is, without the mark of a weak tag; empty is absent."""
    value = F.regexp_replace(F.trim(headers[name]), "^W/", "")
    return F.when(value != "", value)


def lower_names(headers):
    """Headers by lower-case name; of equal names the last in the order of the map stays."""
    return F.aggregate(
        F.map_entries(headers), F.create_map().cast("map<string,string>"),
        lambda m, e: F.map_concat(
            F.map_filter(m, lambda k, _: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])))


def resolve_revisits(captures):
    """All columns of (id, url, time, status, headers, digest), with ``canonical``, ``state``,
    ``source_id`` and ``source_time`` of the response used, and headers and digest merged."""
    none = F.create_map().cast("map<string,string>")
    rows = captures.select(
        "id", "url", "time", "status", F.coalesce(lower_names(F.col("headers")), none).alias("headers"), "digest",
        canonical_url(F.col("url")).alias("canonical"), F.date_trunc("hour", "time").alias("hour"))
    full = (F.col("status") == 200) & F.col("digest").isNotNull() & F.col("canonical").isNotNull() & F.col("time").isNotNull()
    stored = F.when(full, F.struct("id", "time", "headers", "digest"))
    # At one time a revisit comes before the responses, so that only earlier ones count.
    order = ["time", F.col("stored").isNotNull(), "id"]
    rows = rows.withColumn("stored", stored)
    # One row for each URL and hour that has a response: its last.
    last = F.row_number().over(Window.partitionBy("canonical", "hour").orderBy(F.desc("time"), F.desc("id")))
    tails = rows.where("stored IS NOT NULL").withColumn("place", last).where("place = 1").select(
        "canonical", "hour", "stored")
    # Every (URL, hour) with captures gets the tail of the latest earlier hour.
    hours = rows.where("canonical IS NOT NULL AND hour IS NOT NULL").select("canonical", "hour").distinct()
    before = Window.partitionBy("canonical").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = hours.join(tails, ["canonical", "hour"], "left").select(
        "canonical", "hour", F.last("stored", ignorenulls=True).over(before).alias("carried"))
    lost = F.when(F.col("canonical").isNull() | F.col("time").isNull(), F.xxhash64("id"))
    inside = Window.partitionBy("canonical", "hour", lost).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("inside", F.last("stored", ignorenulls=True).over(inside))
    found = found.join(carried, ["canonical", "hour"], "left").withColumn("base", F.coalesce("inside", "carried"))
    tags = [(validator(F.col("headers"), n), validator(F.col("base.headers"), n)) for n in ("etag", "last-modified")]
    agrees = F.coalesce(*[F.when(a.isNotNull() & b.isNotNull(), a == b) for a, b in tags])
    revisit = F.coalesce(F.col("status") == 304, F.lit(False))
    state = (
        F.when(~revisit, F.when(F.col("stored").isNotNull(), "response").otherwise("other"))
        .when(F.col("canonical").isNull() | F.col("time").isNull() | F.col("base").isNull(), "orphan")
        .when(agrees.isNull(), "unverified").when(agrees, "resolved").otherwise("mismatch"))
    found = found.withColumn("state", state)
    resolved = F.col("state") == "resolved"
    update = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("base.headers", lambda k, _: ~F.map_contains_key(update, k)), update)
    return found.select(
        "id", "url", "canonical", "time", "status", "state",
        F.when(resolved, F.col("base.id")).alias("source_id"), F.when(resolved, F.col("base.time")).alias("source_time"),
        F.when(resolved, merged).otherwise(F.col("headers")).alias("headers"),
        F.when(resolved, F.col("base.digest")).otherwise(F.col("digest")).alias("digest"))
