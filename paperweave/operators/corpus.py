"""The collection as zones: title, abstract and body of every known paper, per peer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.plans.runtime import distinct_by

ZONES = ("title", "abstract", "body")


def known_papers(papers: DataFrame) -> DataFrame:
    """Papers with a title, each once per peer; a paper without one is not indexed."""
    return distinct_by(papers, "peer", "urn").where(F.length(F.coalesce("title", F.lit(""))) > 0)


def zones_of(papers: DataFrame, zones: tuple[str, ...] = ZONES) -> DataFrame:
    """(peer, urn, zone, text); null and empty texts have no zone."""
    pairs = F.create_map(*(x for z in zones for x in (F.lit(z), F.col(z))))
    return papers.select("peer", "urn", F.explode(pairs).alias("zone", "text")).where(F.length("text") > 0)


def paper_counts(papers: DataFrame) -> DataFrame:
    """(peer, n_papers)"""
    return papers.groupBy("peer").agg(F.count("*").alias("n_papers"))
