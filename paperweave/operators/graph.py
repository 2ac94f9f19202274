"""The citation graph of each peer and its random-walk rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperweave.plans.runtime import cut_lineage


def edges_of(citations: DataFrame, papers: DataFrame, self_citations: bool = False) -> DataFrame:
    """(peer, citing_urn, cited_urn), distinct, between known papers of one peer."""
    known = papers.select("peer", "urn")
    edges = citations.select("peer", "citing_urn", "cited_urn").distinct()
    if not self_citations:
        edges = edges.where("citing_urn <> cited_urn")
    return edges.join(known.withColumnRenamed("urn", "citing_urn"), ["peer", "citing_urn"], "left_semi").join(known.withColumnRenamed("urn", "cited_urn"), ["peer", "cited_urn"], "left_semi")


def graph_counters(references: DataFrame, links: DataFrame) -> DataFrame:
    """(peer, papers_citing, strings_total, strings_analysed, edges_added): reference strings of each peer, those without a link so far, and the links that the linker found for them."""
    refs = references.where("citing_urn is not null and ref_pos is not null").groupBy("peer", "citing_urn", "ref_pos").agg(F.max("cited_urn").alias("cited_urn"))
    strings = refs.groupBy("peer").agg(F.count_distinct("citing_urn").alias("papers_citing"), F.count("*").alias("strings_total"), F.count_if(F.col("cited_urn").isNull()).alias("strings_analysed"))
    added = links.groupBy("peer").agg(F.count("*").alias("edges_added"))
    return strings.join(added, "peer", "left").withColumn("edges_added", F.coalesce("edges_added", F.lit(0)))


def adjacency_lines(papers: DataFrame, edges: DataFrame) -> DataFrame:
    """(peer, urn, line): for each paper, in the order of urns, 1 for every paper of the peer that it cites and 0 for every other.

    Only where the dense dump is wanted: a line is as long as the peer has papers.
    """
    place = F.row_number().over(Window.partitionBy("peer").orderBy("urn"))
    numbered = papers.select("peer", "urn").distinct().withColumn("place", place)
    n = numbered.groupBy("peer").agg(F.max("place").alias("n"))
    cited = edges.join(numbered.select("peer", F.col("urn").alias("cited_urn"), "place"), ["peer", "cited_urn"]).groupBy("peer", F.col("citing_urn").alias("urn")).agg(F.collect_set("place").alias("cited"))
    held = numbered.drop("place").join(n, "peer").join(cited, ["peer", "urn"], "left")
    cells = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.when(F.array_contains("cited", i), "1 ").otherwise("0 "))
    return held.select("peer", "urn", F.array_join(cells, "").alias("line"))


def dangling_nodes(papers: DataFrame, edges: DataFrame) -> DataFrame:
    """Papers that cite none."""
    return papers.select("peer", "urn").join(edges.select("peer", F.col("citing_urn").alias("urn")), ["peer", "urn"], "left_anti")


def pagerank(papers: DataFrame, edges: DataFrame, alpha: float = 0.85, convergence: float = 0.01, check_steps: int = 10, most_batches: int = 50) -> DataFrame:
    """(peer, urn, rank) of every paper, isolated ones too.

    Ranks start at 1/N. A batch divides them by their sum and takes ``check_steps`` steps x' = (1 - a) S/N + a D/N + a * sum of x/outdegree over
    citing papers, with the sum S and the share D of papers that cite none. A peer is settled when the last step of a batch changed its ranks by less
    than ``convergence`` * N in Euclidean length; ranks of settled peers stay. A peer without papers has no ranks.
    """
    out = edges.groupBy("peer", F.col("citing_urn").alias("urn")).agg(F.count("*").alias("out"))
    nodes = papers.select("peer", "urn").distinct()
    n = nodes.groupBy("peer").agg(F.count("*").alias("n"))
    state = nodes.join(n, "peer").join(out, ["peer", "urn"], "left").select("peer", "urn", "n", F.coalesce("out", F.lit(0)).alias("out"), (1.0 / F.col("n")).alias("rank"))
    state = cut_lineage(state.withColumns({"before": F.lit(0.0), "settled": F.lit(False)}))
    links = cut_lineage(edges.select("peer", F.col("citing_urn").alias("urn"), "cited_urn").repartition("peer", "urn"))
    for _ in range(most_batches):
        for step in range(check_steps):
            sums = state.groupBy("peer").agg(F.sum("rank").alias("all"), F.sum(F.when(F.col("out") == 0, F.col("rank")).otherwise(0.0)).alias("lost"))
            # dividing by the sum at the start of a batch is folded into the first step
            scale = F.col("all") if step == 0 else F.lit(1.0)
            given = state.where("out > 0").join(links, ["peer", "urn"]).groupBy("peer", F.col("cited_urn").alias("urn")).agg(F.sum(F.col("rank") / F.col("out")).alias("given"))
            moved = ((1 - alpha) * F.col("all") + alpha * F.col("lost")) / scale / F.col("n") + alpha * F.coalesce("given", F.lit(0.0)) / scale
            joined = state.join(sums, "peer").join(given, ["peer", "urn"], "left")
            state = cut_lineage(
                joined.select("peer", "urn", "n", "out", F.when(F.col("settled"), F.col("rank")).otherwise(moved).alias("rank"), F.when(F.col("settled"), F.col("before")).otherwise(F.col("rank") / scale).alias("before"), "settled")
            )
        change = state.groupBy("peer").agg((F.sqrt(F.sum((F.col("rank") - F.col("before")) ** 2)) / F.max("n") < convergence).alias("now"))
        state = cut_lineage(state.join(change, "peer").select("peer", "urn", "n", "out", "rank", "before", (F.col("settled") | F.col("now")).alias("settled")))
        if state.where(~F.col("settled")).isEmpty():
            break
    return state.select("peer", "urn", "rank")


def dense_pagerank(papers: DataFrame, edges: DataFrame, p: float = 0.85, times: int = 50) -> DataFrame:
    """The variant without papers that cite none: x' = (1 - p)/N + p * sum of x/outdegree, from 1/N, ``times`` times. It raises if a paper cites none."""
    if not dangling_nodes(papers, edges).isEmpty():
        raise ValueError("every paper must cite another in the dense variant")
    out = edges.groupBy("peer", F.col("citing_urn").alias("urn")).agg(F.count("*").alias("out"))
    nodes = papers.select("peer", "urn").distinct().join(out, ["peer", "urn"])
    n = F.count("*").over(Window.partitionBy("peer"))
    state = cut_lineage(nodes.select("peer", "urn", "out", n.alias("n")).withColumn("rank", 1.0 / F.col("n")))
    links = edges.select("peer", F.col("citing_urn").alias("urn"), "cited_urn")
    for i in range(times):
        given = state.join(links, ["peer", "urn"]).groupBy("peer", F.col("cited_urn").alias("urn")).agg(F.sum(F.col("rank") / F.col("out")).alias("given"))
        state = state.join(given, ["peer", "urn"], "left").select("peer", "urn", "out", "n", ((1 - p) / F.col("n") + p * F.coalesce("given", F.lit(0.0))).alias("rank"))
        state = cut_lineage(state)
    return state.select("peer", "urn", "rank")


def color_scale(ranks: DataFrame) -> DataFrame:
    """(peer, urn, rank, color): ln(rank / smallest rank of the peer), brought to at most 0.6, in steps of a tenth from 1."""
    peer = Window.partitionBy("peer")
    logs = ranks.withColumn("l", F.ln(F.col("rank") / F.min("rank").over(peer)))
    value = F.coalesce(F.try_divide(F.col("l") * 0.6, F.max("l").over(peer)), F.lit(0.0))
    return logs.select("peer", "urn", "rank", (F.ceil(F.round(value * 10, 9)) + 1).cast("int").alias("color"))


def dot_lines(ranks: DataFrame, edges: DataFrame, papers: DataFrame) -> DataFrame:
    """(peer, part, line): Graphviz statements, nodes with label, rank and colour before edges; order by peer, part, line to write them."""
    from paperweave.functions.text import wrap_label

    shown = color_scale(ranks).join(papers.select("peer", "urn", "title"), ["peer", "urn"], "left")
    label = F.concat(wrap_label(F.regexp_replace(F.coalesce("title", F.lit("")), '"', "'")), F.format_string("\\nPR:%.4f", F.col("rank")))
    nodes = shown.select("peer", F.lit(1).alias("part"), F.format_string('"%s" [label="%s", style=filled, colorscheme=blues9, color=%d];', "urn", label, "color").alias("line"))
    arrows = edges.select("peer", F.lit(2).alias("part"), F.format_string('"%s" -> "%s";', "citing_urn", "cited_urn").alias("line"))
    return nodes.union(arrows)
