"""Similarity of peers, their closest peers, and what these recommend and find."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperweave.operators.index import Index
from paperweave.operators.search import FULL_TEXT, TITLE_AND_ABSTRACT, score_zones, top_k
from paperweave.plans.runtime import cut_lineage


def similarities(profiles: DataFrame) -> DataFrame:
    """(peer_a, peer_b, sim): cosines of all two peers with a common term, each with itself too. Peers of length 0 have none; pairs that are
    missing have the similarity 0. The join is on terms, so its size follows the profiles' overlap, not the square of the peers."""
    length = profiles.groupBy("peer").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length")).where("length > 0")
    unit = profiles.join(length, "peer").select("peer", "term", (F.col("weight") / F.col("length")).alias("w"))
    a, b = unit.select("term", F.col("peer").alias("peer_a"), F.col("w").alias("wa")), unit.select("term", F.col("peer").alias("peer_b"), F.col("w").alias("wb"))
    return a.join(b, "term").groupBy("peer_a", "peer_b").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim"))


def buddies(similar: DataFrame, h: int = 2, live: DataFrame | None = None) -> DataFrame:
    """(peer, buddy_rank, buddy, sim): up to ``h`` most similar other peers, similar at all; ties go to the alphabetically first. ``live``: only peers that are there, on both sides."""
    pairs = similar.where("peer_a <> peer_b and sim > 0").select(F.col("peer_a").alias("peer"), F.col("peer_b").alias("buddy"), "sim")
    rank = F.row_number().over(Window.partitionBy("peer").orderBy(F.desc(F.round("sim", 9)), "buddy"))
    chosen = pairs.withColumn("buddy_rank", rank).where(F.col("buddy_rank") <= h)
    if live is not None:
        chosen = chosen.join(live.select("peer"), "peer", "left_semi").join(live.select(F.col("peer").alias("buddy")), "buddy", "left_semi")
    return chosen.select("peer", "buddy_rank", "buddy", "sim")


def friendship_stats(peers: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row: peers, peers without a buddy, friendships."""
    held = peers.join(chosen.groupBy("peer").agg(F.count("*").alias("n")), "peer", "left")
    return held.agg(F.count("*").alias("peers"), F.count_if(F.col("n").isNull()).alias("alone"), F.coalesce(F.sum("n"), F.lit(0)).alias("friendships"))


def recommendations(index: Index, chosen: DataFrame, top50: DataFrame, n: int = 2) -> DataFrame:
    """(peer, buddy, urn, score, result_rank): on each buddy's titles, the best papers for the asker's heaviest terms."""
    asked = chosen.join(top50.select("peer", "term"), "peer").select(F.col("peer").alias("asker"), F.col("buddy").alias("peer"), "term")
    idf = index.idf.where("zone = 'title'")
    weighed = asked.join(idf, ["peer", "term"])
    length = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy("asker", "peer")))
    query = weighed.withColumn("q", F.when(length > 0, F.col("idf") / length).otherwise(0.0)).select("asker", "peer", "term", "q")
    scores = index.postings.where("zone = 'title'").join(query, ["peer", "term"]).groupBy("asker", "peer", "urn").agg(F.sum(F.col("weight") * F.col("q")).alias("score"))
    return top_k(scores, n, "asker", "peer").select(F.col("asker").alias("peer"), F.col("peer").alias("buddy"), "urn", "score", "result_rank")


def federated_search(index: Index, queries: DataFrame, peer: str, chosen: DataFrame | None, local_k: int = 10, buddy_k: int = 4) -> DataFrame:
    """(query_id, origin, urn, score, result_rank): the peer's own results and, kept apart, those of its buddies by their full texts and their own statistics.

    ``chosen`` None asks all peers.
    """
    local = top_k(score_zones(index, queries, TITLE_AND_ABSTRACT).where(F.col("peer") == peer).drop("terms_found"), local_k, "query_id", "peer")
    others = score_zones(index, queries, FULL_TEXT).where(F.col("peer") != peer).drop("terms_found")
    if chosen is not None:
        asked = chosen.where(F.col("peer") == peer).select(F.col("buddy").alias("peer"))
        others = others.join(asked, "peer", "left_semi")
    found = top_k(others, buddy_k, "query_id", "peer")
    columns = ["query_id", F.col("peer").alias("origin"), "urn", "score", "result_rank"]
    return local.select(*columns).union(found.select(*columns))


def gossip_traffic(terms: int, gv: int = 3, gc: int = 3, term_bytes: int = 10) -> int:
    """Bytes that a peer moves per cycle of the two gossip layers: 4 times the profile size times the items exchanged."""
    return 4 * terms * term_bytes * (gv + gc)


def gossip_neighbours(similar: DataFrame, start: DataFrame, h: int = 2, cycles: int = 5) -> DataFrame:
    """(peer, buddy, sim): closest peers found by gossip from the links in ``start`` (peer, buddy): in every cycle a peer hears of its
    neighbours' neighbours and of who names it, and keeps the ``h`` most similar. Its fixed point is that of the central computation on a connected start."""
    sims = similar.where("peer_a <> peer_b and sim > 0").select(F.col("peer_a").alias("peer"), F.col("peer_b").alias("buddy"), "sim")
    view = start.select("peer", "buddy").distinct()
    best = None
    for _ in range(cycles):
        both = view.union(view.select("buddy", "peer")).distinct()
        heard = both.union(both.alias("x").join(both.alias("y"), F.col("x.buddy") == F.col("y.peer")).select("x.peer", "y.buddy")).where("peer <> buddy").distinct()
        rank = F.row_number().over(Window.partitionBy("peer").orderBy(F.desc(F.round("sim", 9)), "buddy"))
        best = heard.join(sims, ["peer", "buddy"]).withColumn("place", rank).where(F.col("place") <= h).select("peer", "buddy", "sim")
        best = cut_lineage(best)
        view = cut_lineage(best.select("peer", "buddy").union(start.select("peer", "buddy")).distinct())
    return best
