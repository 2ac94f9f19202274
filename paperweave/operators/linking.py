"""Citation links between references and known papers of the same peer, by filter and refine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperweave.functions.text import raw_tokens, reference_tokens
from paperweave.operators.edits import nearest_titles
from paperweave.operators.index import Index
from paperweave.plans.runtime import cut_lineage, ship_package


def overlap_of(candidate: Column, query: Column) -> Column:
    """Share of the candidate's title tokens, with repeats, that the query holds; null for a title without tokens."""
    return F.try_divide(F.size(F.filter(candidate, lambda t: F.array_contains(query, t))).cast("double"), F.size(candidate))


#: Scores are compared to nine places; bounds leave out nothing within this distance.
SLACK = 1e-6


def _word_mask(words: Column) -> Column:
    """64 bits, those of the words set: a bit that only one of two texts has stands for at least one word that the other lacks."""
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda mask, w: mask.bitwiseOR(bit(w)))


def _overlapping(papers: DataFrame, queries: DataFrame, least_overlap: float) -> DataFrame:
    """(peer, qid, urn, overlap) of all pairs with more than ``least_overlap`` of the title's tokens in the query.

    Of a title's tokens, the rarest first, one of as many as it takes to lack too many must be in the query, so pairs meet on these only. Most are told
    by 64 bits a text; the tokens of the others are compared.
    """
    words = queries.select("peer", "qid", F.array_distinct(F.split("query", " ")).alias("words")).select("peer", "qid", _word_mask(F.col("words")).alias("mask"), F.explode("words").alias("term"))
    used = words.groupBy("peer", "term").agg(F.count("*").alias("used"))
    titles = papers.select("peer", "urn", F.filter(raw_tokens(F.col("title")), lambda t: t != "").alias("candidate")).withColumns({"n": F.size("candidate"), "own": F.array_distinct("candidate")})
    tokens = titles.select("peer", "urn", "n", F.explode("own").alias("term"), "candidate").select("peer", "urn", "n", "term", (F.col("n") - F.size(F.array_remove("candidate", F.col("term")))).alias("m"))
    paper = Window.partitionBy("peer", "urn")
    rare = tokens.join(used, ["peer", "term"], "left").withColumns({"before": F.coalesce(F.sum("m").over(paper.orderBy(F.coalesce("used", F.lit(0)), "term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "lost": F.sum(F.when(F.col("used").isNull(), F.col("m")).otherwise(0)).over(paper)})
    share = lambda lacking: (F.col("n") - lacking).cast("double") / F.col("n")
    keys = rare.where(F.col("used").isNotNull() & (share(F.col("before")) > least_overlap) & (share(F.col("lost")) > least_overlap)).select("peer", "urn", "term")
    keys = keys.join(titles.select("peer", "urn", "n", "candidate", _word_mask(F.col("own")).alias("own")), ["peer", "urn"])
    met = words.join(keys, ["peer", "term"]).where(share(F.bit_count(F.col("own").bitwiseAND(F.bitwise_not("mask")))) > least_overlap).select("peer", "qid", "urn", "candidate")
    compared = met.join(queries.select("qid", F.split("query", " ").alias("query")), "qid").withColumn("overlap", overlap_of(F.col("candidate"), F.col("query")))
    return compared.where(F.col("overlap") > least_overlap).select("peer", "qid", "urn", "overlap").distinct()


def _asked(index: Index, queries: DataFrame) -> DataFrame:
    """(peer, qid, zone, term, df, q, rest): the weight of each term of a query in each zone, and the length of the query from this term on, the rarest first."""
    terms = queries.select("peer", "qid", F.explode(F.split("query", " ")).alias("term")).groupBy("peer", "qid", "term").agg(F.count("*").alias("m"))
    weighed = terms.join(index.idf.select("peer", "zone", "term", "df", "idf"), ["peer", "term"]).withColumn("wq", F.col("m") * F.col("idf"))
    query = Window.partitionBy("qid", "zone")
    length = F.sqrt(F.sum(F.col("m") * F.col("wq") * F.col("wq")).over(query))
    asked = weighed.withColumn("length", length).withColumn("q", F.when(F.col("length") > 0, F.col("m") * F.col("wq") / F.col("length")).otherwise(0.0))
    return asked.select("peer", "qid", "zone", "term", "df", "q", _rest("q", query).alias("rest"))


def _rest(weight: str, of: Window) -> Column:
    return F.sqrt(F.sum(F.col(weight) * F.col(weight)).over(of.orderBy("df", "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)))


def _dot(vector: Column, weights: Column) -> Column:
    """Of an array of (term, weight) and a map of terms to weights."""
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x["weight"] * F.coalesce(F.element_at(weights, x["term"]), F.lit(0.0)))


def _in_reach(index: Index, asked: DataFrame, known: DataFrame, zones: dict[str, float], k: int, least_score: float | None) -> DataFrame:
    """(peer, qid, urn): every paper whose score may be as high as that of a known (peer, qid, urn) that may be among the best ``k``, those included.

    Within a zone both weights have length 1, so what two texts share from their rarest common term on is at most the product of their lengths from there on: pairs of
    which this is too little are left out before anything is added up, others by their product in the first zone.
    """
    (first, own), *others = zones.items()
    more = sum(zones.values()) - own
    vector = lambda weight: F.collect_list(F.struct("term", F.col(weight).alias("weight")))
    held = index.postings.where(F.col("zone") == first).select("peer", "zone", "urn", "term", "weight").join(index.idf.select("peer", "zone", "term", "df"), ["peer", "zone", "term"])
    paper = Window.partitionBy("peer", "urn")
    held = held.select("peer", "urn", "term", "weight", _rest("weight", paper).alias("left"), vector("weight").over(paper).alias("vector"))
    query = asked.where(F.col("zone") == first).groupBy("peer", "qid").agg(F.map_from_entries(vector("q")).alias("weights"))
    titles = held.groupBy("peer", "urn").agg(F.first("vector").alias("vector"))
    sure = own * F.coalesce(_dot(F.col("vector"), F.col("weights")), F.lit(0.0))
    counted = known.join(query, ["peer", "qid"], "left").join(titles, ["peer", "urn"], "left").select("peer", "qid", "urn", sure.alias("sure"))
    place = Window.partitionBy("qid").orderBy(F.desc("sure"), "urn")
    kth = counted.withColumn("place", F.row_number().over(place)).withColumn("kth", F.max(F.when(F.col("place") == k, F.col("sure"))).over(Window.partitionBy("qid")))
    may = F.col("sure") + more + SLACK
    kept = kth.where((may >= F.coalesce("kth", F.lit(0.0))) & (may > (0.0 if least_score is None else least_score)))
    least = F.min("sure") if least_score is None else F.greatest(F.min("sure"), F.lit(least_score))
    bounds = cut_lineage(kept.groupBy("peer", "qid").agg((least - SLACK).alias("bound")))
    enough = lambda shared: own * shared + more >= F.col("bound")
    rows = asked.where(F.col("zone") == first).join(bounds, ["peer", "qid"]).where(enough(F.col("rest"))).join(query, ["peer", "qid"]).select("peer", "qid", "term", "rest", "weights", "bound")
    reached = rows.join(held, ["peer", "term"]).where(enough(F.col("rest") * F.col("left")) & enough(_dot(F.col("vector"), F.col("weights")))).select("peer", "qid", "urn")
    low = bounds.where(F.col("bound") <= more)
    if others and not low.isEmpty():
        # what shares no term with the query in the first zone can be as high by the others
        rows = asked.where(F.col("zone") != first).join(low, ["peer", "qid"]).select("peer", "qid", "zone", "term")
        reached = reached.union(rows.join(index.postings.select("peer", "zone", "term", "urn"), ["peer", "zone", "term"]).select("peer", "qid", "urn"))
    return reached.distinct()


def link_citations(index: Index, references: DataFrame, alpha: float = 0.90, k: int = 5, least_overlap: float = 0.85, least_score: float | None = None, self_citations: bool = False, unresolved_only: bool = False) -> DataFrame:
    """(peer, citing_urn, ref_pos, cited_urn, overlap): the best of the ``k`` papers that match a reference's title best, if enough of its title is in it.

    Each reference is a query on titles and abstracts with the coefficients ``alpha`` and 1 - ``alpha``. Equal scores and overlaps go to the smaller urn. ``least_score`` is
    the older variant's gate. References without a title have no link. Papers with enough overlap are found first, for each distinct title of a peer once; then, for titles that have any, all
    papers that may score as high, so that the best ``k`` are those of all papers, though most are never scored.
    """
    if least_overlap < 0 or not 0 <= alpha <= 1:
        raise ValueError("the least overlap is not negative and alpha is a share")
    refs = references.where("title is not null and citing_urn is not null").dropDuplicates(["peer", "citing_urn", "ref_pos"])
    if unresolved_only:
        refs = refs.where("cited_urn is null")
    refs = refs.where("ref_pos is not null").select("peer", "citing_urn", "ref_pos", F.array_join(F.array_sort(reference_tokens(F.col("title"))), " ").alias("query"))
    # materialised, so that the numbers stay
    queries = cut_lineage(refs.where("query <> '' and peer is not null").select("peer", "query").distinct().withColumn("qid", F.monotonically_increasing_id()))
    zones = {"title": alpha, "abstract": 1 - alpha}
    index = index.narrowed(tuple(zones))
    known = cut_lineage(_overlapping(index.papers, queries, least_overlap))
    asked = cut_lineage(_asked(index, queries.join(known.select("qid").distinct(), "qid", "left_semi")))
    pairs = _in_reach(index, asked, known.select("peer", "qid", "urn"), zones, k, least_score)
    coefficient = F.when(F.col("zone") == "title", zones["title"]).otherwise(zones["abstract"])
    terms = pairs.join(asked.select("peer", "qid", "zone", "term", "q"), ["peer", "qid"])
    scores = terms.join(index.postings, ["peer", "zone", "term", "urn"]).groupBy("peer", "qid", "urn").agg(F.sum(coefficient * F.col("weight") * F.col("q")).alias("score"))
    order = Window.partitionBy("peer", "qid").orderBy(F.desc(F.round("score", 9)), "urn")
    best = scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    if least_score is not None:
        best = best.where(F.col("score") > least_score)
    refined = best.join(known, ["peer", "qid", "urn"]).join(queries, ["peer", "qid"]).select("peer", "query", "urn", "overlap").join(refs, ["peer", "query"])
    if not self_citations:
        refined = refined.where("urn <> citing_urn")
    reference = ["peer", "citing_urn", "ref_pos"]
    first = F.row_number().over(Window.partitionBy(*reference).orderBy(F.desc("overlap"), "urn"))
    return refined.withColumn("first", first).where("first = 1").select(*reference, F.col("urn").alias("cited_urn"), "overlap")


#: Titles of a peer that one task compares with as many others.
BLOCK = 8192


def link_by_edit_distance(papers: DataFrame, references: DataFrame, below: int = 15) -> DataFrame:
    """(peer, citing_urn, ref_pos, cited_urn, distance): the paper whose title is nearest, if nearer than ``below`` edits; ties go to the smaller urn.

    Each distinct printed title is compared with all distinct titles of its peer, block by block; ``edits.nearest`` tells most pairs apart by their letters and works out the
    distances of the others. So wide a bound leaves no sharper exact filter, so the work grows with references times papers of a peer, and ``link_citations`` is the operator for large peers.
    """
    spark = papers.sparkSession
    ship_package(spark)
    refs = references.where("title is not null").dropDuplicates(["peer", "citing_urn", "ref_pos"]).select("peer", "citing_urn", "ref_pos", F.upper("title").alias("t"))
    printed = refs.where("peer is not null").select("peer", "t").distinct()
    known = papers.where("title is not null").groupBy("peer", F.upper("title").alias("p")).agg(F.min("urn").alias("urn"))
    blocks = lambda df, name: df.groupBy("peer").agg(F.ceil(F.count("*") / BLOCK).alias(name))
    sizes = blocks(printed, "parts").join(blocks(known, "sides"), "peer")
    dealt = lambda text, n: F.pmod(F.xxhash64(text), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    keys = ["peer", "part", "side"]
    # the tables are small for the work on them: by number, as partitions would be put together by size
    n = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = printed.join(sizes, "peer").select("peer", "t", dealt("t", "parts").alias("part"), every("sides").alias("side")).repartition(n, *keys)
    titles = known.join(sizes, "peer").select("peer", "p", "urn", dealt("p", "sides").alias("side"), every("parts").alias("part")).repartition(n, *keys)
    found = asked.groupBy(*keys).cogroup(titles.groupBy(*keys)).applyInArrow(nearest_titles(below - 1), f"peer string, t string, urn {known.schema['urn'].dataType.simpleString()}, distance int")
    nearest = found.groupBy("peer", "t").agg(F.min(F.struct("distance", "urn")).alias("best"))
    return refs.join(nearest, ["peer", "t"]).select("peer", "citing_urn", "ref_pos", F.col("best.urn").alias("cited_urn"), F.col("best.distance").alias("distance"))


def citation_edges(links: DataFrame) -> DataFrame:
    """(peer, citing_urn, cited_urn), each once."""
    return links.select("peer", "citing_urn", "cited_urn").distinct()
