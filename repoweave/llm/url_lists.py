"""URL filters by a temporal join with dated lists.

A list is a table of dated events: a domain is added to a list or removed from it.  Events become
intervals in which the domain is on the list, and every capture of a page is judged by the intervals
that hold at the time it was fetched, never by later knowledge.  An entry covers its domain and all
below it; the most specific entry decides, and an allowing entry beats a blocking one of the same domain.

Time is cut into buckets, so that one domain's events or captures never meet in one task: intervals
are formed within (list, domain, bucket) from that bucket's events and the state that earlier buckets
left, and the join is an equality on (host, bucket) with a test of the interval.  Only buckets in which
a host was captured are formed.  Domains are matched with the distinct (host, bucket), so a capture is
not multiplied by the parts of its host name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoweave.llm.common import stored
from repoweave.sources.scratch import broadcast_if_small

BUCKET_SECONDS = 30 * 86_400
#: Longest host name by the rules of the domain name system (fixed value); longer ones match nothing.
HOST_LENGTH = 253
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host_of(url: Column) -> Column:
    """Host in lower case without a closing dot; null where there is none."""
    host = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when((host != "") & (F.length(host) <= HOST_LENGTH), host)


def domains_of(host: Column) -> Column:
    """The host and every domain above it."""
    parts = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), ".")
    )


def _seconds(at: str) -> Column:
    """A time as a whole number; what is none is null, like a time that is missing."""
    return F.col(at).try_cast("bigint")


def _bucket(at: str) -> Column:
    """Number of the bucket, exact for any 64-bit time."""
    return F.expr(f"{at} div {BUCKET_SECONDS} - if({at} < 0 and {at} % {BUCKET_SECONDS} <> 0, 1, 0)")


def intervals(events: DataFrame, asked: DataFrame) -> DataFrame:
    """(list, domain, bucket, start, end) in which a domain is on a list, for the buckets in ``asked``.

    ``events`` has list, domain, at (seconds) and action (add or remove); ``asked`` has distinct
    (domain, bucket).  A null start or end is that of the bucket.  Of events of one instant a removal
    wins; adding twice is adding once; a removal without an addition does nothing.  Rows with a null
    are left out.  No bucket is made that nothing asks for, so times may lie any distance apart.
    """
    clean = events.select(
        "list", F.rtrim(F.lower("domain"), F.lit(".")).alias("domain"), _seconds("at").alias("at"),
        F.when(F.col("action").isin("add", "remove"), F.col("action") == "remove").alias("off"),
    ).dropna()
    instants = stored(
        clean.groupBy("list", "domain", "at").agg(F.max("off").alias("off")).withColumn("bucket", _bucket("at")),
        "list-events",
    )
    inside = Window.partitionBy("list", "domain", "bucket").orderBy("at")
    opened = (
        instants.withColumn("end", F.lead("at").over(inside)).where(~F.col("off"))
        .select("list", "domain", "bucket", F.col("at").alias("start"), "end")
        .join(asked, ["domain", "bucket"], "left_semi")
    )
    # The state a bucket leaves holds in later ones, up to their first event.  A window holds one row per
    # bucket of a listed domain, whatever the number of captures and events.
    left = instants.groupBy("list", "domain", "bucket").agg(
        F.max_by("off", "at").alias("off"), F.min("at").alias("first")
    )
    listed = asked.join(instants.select("list", "domain").distinct(), "domain")
    buckets = listed.join(left, ["list", "domain", "bucket"], "full").select(
        "list", "domain", "bucket", "off", "first"
    )
    earlier = Window.partitionBy("list", "domain").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        buckets.withColumn("before", F.last("off", ignorenulls=True).over(earlier)).where(~F.col("before"))
        .select("list", "domain", "bucket", F.lit(None).cast("bigint").alias("start"), F.col("first").alias("end"))
    )
    return opened.select(carried.columns).unionByName(carried)


def filter_captures(captures: DataFrame, events: DataFrame) -> DataFrame:
    """One row per capture: page_id, url, host, fetched_at, list and domain that decided, kept.

    ``captures`` has page_id, url and fetched_at (seconds, any 64-bit number).  A capture without host
    or time is kept, as is one that no entry covers.  Repeated captures are judged alike; other columns
    are not looked at.
    """
    rows = stored(
        captures.select(
            F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("bigint").alias("page_id"), "url",
            host_of(F.col("url")).alias("host"), _seconds("fetched_at").alias("fetched_at"),
        ).withColumn("bucket", _bucket("fetched_at")),
        "captures",
    )
    visited = rows.where("host is not null and bucket is not null").select("host", "bucket").distinct()
    covered = stored(visited.select("*", F.explode(domains_of(F.col("host"))).alias("domain")), "list-covered")
    found = stored(intervals(events, covered.select("domain", "bucket").distinct()), "list-intervals")
    valid = stored(covered.join(broadcast_if_small(found), ["domain", "bucket"]), "list-valid")
    hit = rows.select("row", "host", "bucket", "fetched_at").alias("c").join(
        broadcast_if_small(valid).alias("v"),
        (F.col("c.host") == F.col("v.host")) & (F.col("c.bucket") == F.col("v.bucket"))
        & (F.col("v.start").isNull() | (F.col("c.fetched_at") >= F.col("v.start")))
        & (F.col("v.end").isNull() | (F.col("c.fetched_at") < F.col("v.end"))),
    )
    rule = F.max(F.struct(F.length("v.domain").alias("size"), (F.col("v.list") == "allow").alias("allowed"), "v.list", "v.domain"))
    decided = hit.groupBy("c.row").agg(rule.alias("rule"))
    return rows.join(decided, "row", "left").select(
        "page_id", "url", "host", "fetched_at", F.col("rule.list").alias("list"), F.col("rule.domain").alias("domain"),
        F.coalesce("rule.allowed", F.lit(True)).alias("kept"),
    )
