"""A peer's taste: the centroid of its abstracts and its approximations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperweave.functions.porter import porter_stem


def centroid(postings: DataFrame, zone: str = "abstract") -> DataFrame:
    """(peer, term, weight): mean of the document vectors of the zone, over the papers that have the zone, brought to length 1. A peer whose mean is 0 has none."""
    own = postings.where(F.col("zone") == zone)
    n = own.groupBy("peer").agg(F.count_distinct("urn").alias("n"))
    mean = own.groupBy("peer", "term").agg(F.sum("weight").alias("s")).join(n, "peer").withColumn("m", F.col("s") / F.col("n"))
    length = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("peer")))
    return mean.withColumn("length", length).where("length > 0").select("peer", "term", (F.col("m") / F.col("length")).alias("weight"))


def rss(postings: DataFrame, zone: str = "abstract") -> DataFrame:
    """(peer, n_docs, rss): squared distances of the documents from the normalised centroid, as n1 + n - 2 n |mean| with n1 documents of length 1."""
    own = postings.where(F.col("zone") == zone)
    per_doc = own.groupBy("peer", "urn").agg(F.max(F.col("weight") > 0).cast("int").alias("unit"))
    docs = per_doc.groupBy("peer").agg(F.count("*").alias("n_docs"), F.sum("unit").alias("n1"))
    sums = own.groupBy("peer", "term").agg(F.sum("weight").alias("s")).groupBy("peer").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("length"))
    return docs.join(sums, "peer").where("length > 0").select("peer", "n_docs", (F.col("n1") + F.col("n_docs") - 2 * F.col("length")).alias("rss"))


def _order() -> list[Column]:
    """Weights are compared to nine places, so that the order of summation cannot change a rank."""
    return [F.desc(F.round("weight", 9)), F.col("term")]


def top_terms(profile: DataFrame, n: int = 50) -> DataFrame:
    """(peer, term, weight, place): the n heaviest terms of each peer; equal weights in the order of terms."""
    place = F.row_number().over(Window.partitionBy("peer").orderBy(*_order()))
    return profile.withColumn("place", place).where(F.col("place") <= n)


def length_ratio(part: DataFrame, whole: DataFrame) -> DataFrame:
    """(peer, ratio): length of an approximation by that of the whole; no row where either is 0."""
    length = lambda df, name: df.groupBy("peer").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias(name))
    joined = length(part, "a").join(length(whole, "b"), "peer")
    return joined.where("a > 0 and b > 0").select("peer", (F.col("a") / F.col("b")).alias("ratio"))


def stemmed_terms(profile: DataFrame, n: int = 30) -> DataFrame:
    """(peer, term, stem, weight): the terms, heaviest first, up to the one with which the number of different stems reaches ``n``."""
    stems = profile.select("term").distinct().withColumn("stem", porter_stem("term"))
    ordered = profile.join(stems, "term")
    new = (F.row_number().over(Window.partitionBy("peer", "stem").orderBy(*_order())) == 1).cast("int")
    before = F.sum("new").over(Window.partitionBy("peer").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, -1))
    return ordered.withColumn("new", new).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < n).select("peer", "term", "stem", "weight")


def stemmed_profile(profile: DataFrame, n: int = 30) -> DataFrame:
    """(peer, term, weight) with stems as terms, their weights added up."""
    return stemmed_terms(profile, n).groupBy("peer", F.col("stem").alias("term")).agg(F.sum("weight").alias("weight"))
