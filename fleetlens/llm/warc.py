"""Not-modified revisits of WARC captures, resolved to the response they stand for.

A revisit (304) belongs to the latest full response of the same canonical URL that is
strictly earlier. It is accepted when its validators agree with that response: the
entity tag if it has one (weak tags by their value), else the modification date, else
the payload digest; a revisit without any is not accepted. An accepted revisit gets the
response's payload and headers, updated by those of its own headers that a 304 may
update.

The as-of join is two windows over ids and instants only: the time line is cut into slices
of about SLICE_ROWS captures, the latest response inside a slice comes from a window by
URL and slice, and that of earlier slices from a window over the slices' last responses.
So a URL with very many captures is as many tasks as it has slices. Headers and payload
join afterwards, by URL, instant and record id.

States: `resolved`; `mismatch` (validators differ); `unvalidated` (none to compare);
`missing` (no earlier response, or no URL). Of responses at one instant the largest
record id counts as the latest. Revisits of one URL, repeated or not, are resolved one by
one, and give one row each; a response that is repeated under its id counts once, and where its
copies differ, the one whose headers and payload have the lowest hash. Records without an instant have no place in time and are missing. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 100_000
MAX_SLICES = 4_096

# Headers that a 304 may update, and query parameters that name no resource.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)="


def canonical(url: Column) -> Column:
    """Host in lower case, without scheme, www, default port, fragment, tracking parameters and last slash."""
    rest = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(rest, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(query), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _earlier(events: DataFrame) -> DataFrame:
    """(url_key, ts, refers_to, refers_ts): each instant of a revisit once, with the latest response before it, if any."""
    n = min(MAX_SLICES, max(1, -(-events.count() // SLICE_ROWS)))
    cuts = sorted({float(c) for c in events.approxQuantile("ts", [i / n for i in range(1, n)], 0.1 / n)}) if n > 1 else []
    part = F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c <= F.col("ts"))) if cuts else F.lit(0)
    # Captures of a URL at one instant, repeated or not, are one row.
    instants = events.groupBy("url_key", "ts").agg(
        F.max("full").alias("full"), F.max(~F.col("full")).alias("asked"),
        F.max(F.when(F.col("full"), F.col("record_id"))).alias("record_id")).withColumn("slice", part)
    response = F.when(F.col("full"), F.struct("ts", "record_id"))
    order = Window.partitionBy("url_key", "slice").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    inside = instants.withColumn("near", F.last(response, ignorenulls=True).over(order)).filter("asked")
    lasts = instants.filter("full").groupBy("url_key", "slice").agg(F.max(F.struct("ts", "record_id")).alias("last"))
    # Every slice of a URL that has captures, with the last response of the slices before.
    slices = instants.select("url_key", "slice").distinct().join(lasts, ["url_key", "slice"], "left")
    before = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("url_key", "slice", F.last("last", ignorenulls=True).over(before).alias("far"))
    last = F.coalesce("near", "far")
    return inside.join(slices, ["url_key", "slice"]).select(
        "url_key", "ts", last.getField("record_id").alias("refers_to"), last.getField("ts").alias("refers_ts"))


def _tag(column: Column) -> Column:
    return F.regexp_replace(column, "^W/", "")


def resolved(records: DataFrame, *, id_col: str = "record_id", type_col: str = "type", url_col: str = "url",
             time_col: str = "ts", headers_col: str = "headers", payload_col: str = "payload") -> DataFrame:
    """One row per revisit: what it refers to, its state, and the response it stands for.

    Headers are maps with lower-case names; a payload may be any column (its digest
    and length, or the bytes) and comes back as it is.
    """
    rows = records.select(F.col(id_col).alias("record_id"), F.lower(F.col(type_col)).alias("type"),
                          canonical(F.col(url_col)).alias("url_key"), F.col(time_col).alias("ts"),
                          F.col(headers_col).alias("headers"), F.col(payload_col).alias("payload"))
    events = rows.filter(F.col("type").isin("response", "revisit") & F.col("url_key").isNotNull() & F.col("ts").isNotNull())
    found = _earlier(events.select("record_id", "url_key", "ts", (F.col("type") == "response").alias("full")))
    revisits = rows.filter("type = 'revisit'").drop("payload").join(found, ["url_key", "ts"], "left")
    # A response that is given several times counts once.
    given = F.struct(F.col("headers").alias("stored"), "payload")
    full = (rows.filter("type = 'response'")
            .groupBy(F.col("record_id").alias("refers_to"), F.col("ts").alias("refers_ts"), "url_key")
            .agg(F.min_by(given, F.xxhash64(F.to_json(given))).alias("given")).select("refers_to", "refers_ts", "url_key", "given.*"))
    both = revisits.join(full, ["refers_to", "refers_ts", "url_key"], "left")

    def header(side: str, name: str) -> Column:
        return F.col(side)[name]

    agrees = (F.when(header("headers", "etag").isNotNull(),
                     _tag(header("headers", "etag")) == F.coalesce(_tag(header("stored", "etag")), F.lit("")))
              .when(header("headers", "last-modified").isNotNull(),
                    header("headers", "last-modified") == F.coalesce(header("stored", "last-modified"), F.lit("")))
              .when(header("headers", "warc-payload-digest").isNotNull(), header("headers", "warc-payload-digest")
                    == F.coalesce(header("stored", "warc-payload-digest"), F.lit(""))))
    state = (F.when(F.col("refers_to").isNull(), "missing").when(agrees.isNull(), "unvalidated")
             .when(agrees, "resolved").otherwise("mismatch"))
    update = F.map_filter("headers", lambda k, v: k.isin(PERMITTED) & v.isNotNull())
    kept = F.map_filter("stored", lambda k, v: ~F.array_contains(F.map_keys(update), k))
    both = both.withColumn("state", state)
    accepted = F.col("state") == "resolved"
    return both.select("record_id", "url_key", "ts", "state", F.when(accepted, F.col("refers_to")).alias("refers_to"),
                       F.when(accepted, F.col("refers_ts")).alias("refers_ts"),
                       F.when(accepted, F.map_concat(kept, update)).alias("headers"),
                       F.when(accepted, F.col("payload")).alias("payload"))
