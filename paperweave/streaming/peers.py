"""Streams of peer events and profiles: liveness, registration, latest profile, and incremental ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIRST_PORT = 16200


def presence(events: DataFrame, gap: str = "60 seconds", late: str | None = None) -> DataFrame:
    """(peer, seen_from, seen_to, events) of every stretch in which a peer was heard of without a silence of ``gap``; works on streams and tables.

    Events without a peer or time are ignored, repeats are harmless to the stretches. On a stream, events later than ``late`` (by default the gap) behind the newest are dropped.
    """
    heard = events.where("peer is not null and ts is not null")
    if events.isStreaming:
        heard = heard.withWatermark("ts", late or gap)
    spans = heard.groupBy("peer", F.session_window("ts", gap).alias("span")).agg(F.count("*").alias("events"), F.max("ts").alias("seen_to"))
    return spans.select("peer", F.col("span.start").alias("seen_from"), "seen_to", "events")


def live_at(events: DataFrame, moment: str, timeout: str = "60 seconds") -> DataFrame:
    """(peer, last_seen, live): live if the last event up to the moment is no leave and not older than the timeout; of events of one time a leave counts last."""
    until = events.where((F.col("ts") <= F.lit(moment).cast("timestamp")) & F.col("peer").isNotNull())
    last = until.groupBy("peer").agg(F.max(F.struct("ts", (F.col("kind") == "leave").cast("int").alias("left"))).alias("last"))
    fresh = F.col("last.ts") >= F.lit(moment).cast("timestamp") - F.expr(f"interval {timeout}")
    return last.select("peer", F.col("last.ts").alias("last_seen"), (fresh & (F.col("last.left") == 0)).alias("live"))


def registered(events: DataFrame) -> DataFrame:
    """(peer, address, joined_at): the first join of each peer; later joins under a taken name are rejected. Works on streams, where the first to arrive counts."""
    joins = events.where("kind = 'join' and peer is not null")
    if events.isStreaming:
        return joins.select("peer", "address", F.col("ts").alias("joined_at")).dropDuplicates(["peer"])
    first = joins.groupBy("peer").agg(F.min(F.struct("ts", F.coalesce("address", F.lit("")).alias("address"))).alias("first"))
    return first.select("peer", F.nullif("first.address", F.lit("")).alias("address"), F.col("first.ts").alias("joined_at"))


def ports(registrations: DataFrame) -> DataFrame:
    """(peer, address, port): ports of an address in the order of joining; they are never used again."""
    order = Window.partitionBy("address").orderBy("joined_at", "peer")
    return registrations.where("address is not null").select("peer", "address", (FIRST_PORT + F.row_number().over(order)).alias("port"))


def latest_profiles(posts: DataFrame) -> DataFrame:
    """(peer, ts, profile): the post with the greatest time of each peer, in whatever order they came."""
    return posts.groupBy("peer").agg(F.max("ts").alias("ts"), F.max_by("profile", "ts").alias("profile"))


def on_each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None):
    """Run ``step`` on every batch that is not empty; without ``seconds`` over all that is there, then stop."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            step(batch, number)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
