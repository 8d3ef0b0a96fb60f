"""WARC revisit records: the full response behind a "not modified" answer.

A record has record_id, url, ts, kind (``response`` or ``revisit``), headers (a map; names in lower case) and payload.  A revisit is
joined, by canonical URL, to the latest response that is strictly earlier (of equal times the greatest record_id).  Its validators are checked
against that response: the entity tag by weak comparison where the revisit has one, else Last-Modified.  If they
agree, the revisit gets the response's payload and headers, with those headers that a 304 may renew taken from the revisit.

The as-of join works on distinct (URL, time) pairs alone, each with the greatest response of that time, so any number of equal records is one row of it.
Time is cut into ``SLICES`` slices at quantiles of those pairs; within (URL, slice) a window finds the latest response, and what earlier slices hand on is found
among at most ``SLICES`` rows for each URL.  So a URL with a third of all records is spread over about a third of the slices, and a wild time moves no
boundary.  Revisits and responses meet the result by joins that can be split, and payloads move once, to the revisits that resolve.

A null URL is the empty one; records without a time or kind match nothing; null headers are empty.  A revisit without a
validator is unverified and stays unresolved.  Each revisit row gives one row, also rows that repeat or share a record_id; of response rows with one URL, time
and record_id one counts, the one of the greatest hash.  Empty tables give empty results; extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

SLICES = 256
# The headers that a 304 answer may renew.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]


def canonical(url: Column) -> Column:
    """Host in lower case without www., default ports, scheme, user and fragment; no slash at the end; parameters sorted, without trackers (utm_*)."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r"^.*@", ""), r":(80|443)$", ""))
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.startswith("utm_"))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def latest_earlier(pairs: DataFrame) -> DataFrame:
    """(canon, ts, found) for each of the distinct pairs (canon, ts, resp), resp being the response of that time or null: the latest earlier resp, or null."""
    bounds = pairs.agg(F.percentile_approx("ts", [k / SLICES for k in range(1, SLICES)], 100 * SLICES)).first()[0] or []
    bounds = F.array(*(F.lit(b) for b in sorted(set(bounds)))).cast("array<long>")
    keys = pairs.withColumn("slice", F.size(F.filter(bounds, lambda b: b < F.col("ts"))))
    earlier = Window.partitionBy("canon", "slice").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    near = keys.withColumn("near", F.last("resp", ignorenulls=True).over(earlier))
    ends = keys.groupBy("canon", "slice").agg(F.max("resp").alias("resp"))
    before = Window.partitionBy("canon").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("canon", "slice", F.last("resp", ignorenulls=True).over(before).alias("far")).where("far is not null")
    return near.join(carried, ["canon", "slice"], "left").select("canon", "ts", F.coalesce("near", "far").alias("found"))


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, canon, outcome, source_id, headers, payload) for each revisit.

    outcome: ``resolved``, ``mismatch`` (validators differ), ``unverified`` (the revisit has none) or ``missing`` (no earlier response).
    """
    empty = F.create_map().cast("map<string,string>")
    rows = records.select("record_id", canonical(F.col("url")).alias("canon"), F.col("ts").cast("long").alias("ts"), "kind", F.coalesce("headers", empty).alias("headers"), "payload")
    responses = rows.where("kind = 'response' and ts is not null").withColumn("digest", F.xxhash64("payload", F.to_json("headers")))
    revisits = rows.where("kind = 'revisit'")
    # one response of each URL, time and record_id, without its payload; cut, so that the joins below can be split at pairs with very many rows
    slim = responses.groupBy("canon", "ts", "record_id").agg(F.max_by(F.struct("digest", F.col("headers").alias("stored")), "digest").alias("x"), F.max("digest").alias("digest"), F.count("*").alias("n"))
    slim = cut(slim.select("canon", "ts", "record_id", "digest", "x.stored", "n"))
    latest = slim.groupBy("canon", "ts").agg(F.max(F.struct("ts", "record_id")).alias("resp"))
    asked = revisits.where("ts is not null").select("canon", "ts").distinct()
    pairs = cut(latest.unionByName(asked, allowMissingColumns=True).groupBy("canon", "ts").agg(F.max("resp").alias("resp")))
    found = cut(latest_earlier(pairs).where("found is not null").select("canon", "ts", F.col("found.ts").alias("r_ts"), F.col("found.record_id").alias("r_id")))

    joined = revisits.select("record_id", "canon", "ts", F.col("headers").alias("own")).join(found, ["canon", "ts"], "left")
    same = (F.col("canon") == F.col("s_canon")) & (F.col("r_ts") == F.col("s_ts")) & F.col("r_id").eqNullSafe(F.col("s_id"))
    joined = joined.join(slim.select(F.col("canon").alias("s_canon"), F.col("ts").alias("s_ts"), F.col("record_id").alias("s_id"), "stored", "digest", "n"), same, "left")
    tag, modified = F.col("own")["etag"], F.col("own")["last-modified"]
    agrees = F.when(tag.isNotNull(), weak(tag) == weak(F.col("stored")["etag"])).otherwise(modified == F.col("stored")["last-modified"])
    outcome = F.when(F.col("s_ts").isNull(), "missing").when(tag.isNull() & modified.isNull(), "unverified").when(F.coalesce(agrees, F.lit(False)), "resolved").otherwise("mismatch")
    fresh = F.map_filter("own", lambda k, v: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    good = F.col("outcome") == "resolved"
    judged = joined.withColumn("outcome", outcome)
    judged = judged.select(
        "record_id", "canon", "outcome", F.when(good, F.col("s_id")).alias("source_id"), F.when(good, merged).otherwise(F.col("own")).alias("headers"),
        F.when(good, F.col("s_ts")).alias("s_ts"), F.when(good, F.col("digest")).alias("digest"), F.when(good, F.col("n")).alias("n"),
    )
    bodies = responses.select(F.col("canon").alias("b_canon"), F.col("ts").alias("b_ts"), F.col("record_id").alias("b_id"), F.col("digest").alias("b_digest"), "payload")
    on = (F.col("canon") == F.col("b_canon")) & (F.col("s_ts") == F.col("b_ts")) & F.col("source_id").eqNullSafe(F.col("b_id")) & (F.col("digest") == F.col("b_digest"))
    if slim.where("n > 1").isEmpty():
        out = judged.join(bodies, on, "left")
    else:  # response rows that repeat: one body of each
        several = slim.where("n > 1").select(F.col("canon").alias("b_canon"), F.col("ts").alias("b_ts"), F.col("record_id").alias("m_id"), F.col("digest").alias("b_digest"))
        again = bodies.join(several, ["b_canon", "b_ts", "b_digest"]).where(F.col("b_id").eqNullSafe(F.col("m_id")))
        again = cut(again.groupBy("b_canon", "b_ts", "b_id", "b_digest").agg(F.max("payload").alias("payload")))
        out = judged.where("n is null or n = 1").join(bodies, on, "left").unionByName(judged.where("n > 1").join(again, on, "left"))
    return out.select("record_id", "canon", "outcome", "source_id", "headers", "payload")
