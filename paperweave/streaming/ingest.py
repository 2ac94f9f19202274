"""Incremental ingestion: new papers and references into their tables; changed peers re-indexed, re-profiled, linked and ranked again."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from paperweave.operators import graph, linking, profiles, social
from paperweave.operators.index import build_index
from paperweave.sources.files import insert_if_absent
from paperweave.streaming.peers import on_each_batch


class Collection:
    """Tables under one shared folder, by peer: papers, references, postings and idf values, profiles, links, ranks and counters of the citation graph."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def _replace(self, table: DataFrame, name: str) -> None:
        """Write the rows of some peers in place of those that they had."""
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("peer").parquet(self.path(name))

    def _of(self, name: str, peers: DataFrame) -> DataFrame:
        return self.spark.read.parquet(self.path(name)).join(peers, "peer", "left_semi")

    def ingest(self, papers: DataFrame, references: DataFrame | None = None) -> None:
        """Papers, and references (peer, citing_urn, ref_pos, title, cited_urn), that are not known yet are added; the peers they belong to are indexed, and if there are references linked and ranked,
        again, as their statistics changed."""
        insert_if_absent(papers, self.path("papers"), "peer", "urn")
        changed = papers.select("peer").distinct()
        index = build_index(self._of("papers", changed))
        self._replace(index.idf, "idf")
        self._replace(index.postings, "postings")
        self._replace(profiles.top_terms(profiles.centroid(self._of("postings", changed))), "profiles")
        if references is not None:
            insert_if_absent(references, self.path("references"), "peer", "citing_urn", "ref_pos")
            self.analyse(changed.union(references.select("peer")).distinct())

    def analyse(self, changed: DataFrame) -> None:
        """Build the citation graphs of some peers from their references and rank their papers."""
        own = build_index(self._of("papers", changed))
        stored = replace(own, idf=self._of("idf", changed), postings=self._of("postings", changed)).narrowed(("title", "abstract"))
        references = self._of("references", changed)
        self._replace(linking.link_citations(stored, references), "links")
        links = self._of("links", changed)
        self._replace(graph.graph_counters(references, links.join(references.where("cited_urn is null").select("peer", "citing_urn", "ref_pos"), ["peer", "citing_urn", "ref_pos"], "left_semi")), "counters")
        self._replace(graph.pagerank(own.papers, graph.edges_of(linking.citation_edges(links), own.papers)), "ranks")

    def recommendations(self, h: int = 2, n: int = 2) -> DataFrame:
        """What each peer's neighbours have for its heaviest terms, as the tables stand now."""
        held = {name: self.spark.read.parquet(self.path(name)) for name in ("papers", "idf", "postings", "profiles")}
        index = replace(build_index(held["papers"]), idf=held["idf"], postings=held["postings"])
        return social.recommendations(index, self.neighbours(h), held["profiles"], n)

    def neighbours(self, h: int = 2) -> DataFrame:
        return social.buddies(social.similarities(self.spark.read.parquet(self.path("profiles"))), h)

    def follow(self, stream: DataFrame, checkpoint: str, seconds: int | None = None):
        """Ingest every batch of a stream of papers."""
        return on_each_batch(stream, lambda batch, _: self.ingest(batch), checkpoint, seconds)
