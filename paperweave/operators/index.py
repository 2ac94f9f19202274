"""Per-zone inverted index with tf-idf weights. All statistics are per peer."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperweave.functions.text import explode_terms
from paperweave.operators.corpus import ZONES, known_papers, paper_counts, zones_of


def term_frequencies(zones: DataFrame) -> DataFrame:
    """(peer, zone, urn, term, tf): one partial aggregate and one shuffle of distinct terms per text."""
    return explode_terms(zones, "text").groupBy("peer", "zone", "urn", "term").agg(F.count("*").cast("int").alias("tf"))


def document_frequencies(frequencies: DataFrame, counts: DataFrame) -> DataFrame:
    """(peer, zone, term, df, idf): idf is ln(papers of the peer / papers with the term in the zone)."""
    df = frequencies.groupBy("peer", "zone", "term").agg(F.count("*").alias("df"))
    return df.join(counts, "peer").select("peer", "zone", "term", "df", F.ln(F.col("n_papers") / F.col("df")).alias("idf"))


def weigh(frequencies: DataFrame, idf: DataFrame) -> DataFrame:
    """(peer, zone, urn, term, tf, weight): tf * idf, brought to length 1 within each zone of a paper; 0 where the length is 0."""
    raw = frequencies.join(idf, ["peer", "zone", "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("peer", "zone", "urn")))
    return raw.select("peer", "zone", "urn", "term", "tf", F.when(length > 0, F.col("w") / length).otherwise(0.0).alias("weight"))


#: Folders per zone of the stored postings: a query reads those of its terms.
BUCKETS = 32


def bucket(term: Column) -> Column:
    return F.pmod(F.crc32(F.encode(term, "utf-8")), F.lit(BUCKETS)).cast("int")


@dataclass
class Index:
    """The papers of all peers with their term frequencies, idf values and postings."""

    papers: DataFrame
    counts: DataFrame
    frequencies: DataFrame
    idf: DataFrame
    postings: DataFrame
    #: Whether idf and postings have the column ``bucket`` by which they are stored.
    bucketed: bool = False

    def narrowed(self, zones: tuple[str, ...], terms: list[str] | None = None) -> Index:
        """Only the idf values and postings of some zones and terms; of a stored index nothing else is read."""
        keep = F.col("zone").isin(*zones)
        if terms is not None:
            keep = keep & F.col("term").isin(*terms)
            if self.bucketed:
                keep = keep & F.col("bucket").isin(*sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms}))
        return replace(self, idf=self.idf.where(keep), postings=self.postings.where(keep))


def build_index(papers: DataFrame, zones: tuple[str, ...] = ZONES) -> Index:
    """Lazily planned, so only the zones and peers asked for are computed."""
    known = known_papers(papers)
    counts = paper_counts(known)
    frequencies = term_frequencies(zones_of(known, zones))
    idf = document_frequencies(frequencies, counts)
    return Index(known, counts, frequencies, idf, weigh(frequencies, idf))


def write_index(index: Index, folder: str) -> None:
    """Postings and idf values as Parquet, in folders by zone and a bucket of the term and in the order of terms, so that a query reads few row groups.
    The texts are read once."""
    def store(df: DataFrame, name: str, *order: str) -> None:
        # by range, so that a term of very many papers is spread over tasks
        placed = df.withColumn("bucket", bucket(F.col("term"))).repartitionByRange("zone", "bucket", "term", *order).sortWithinPartitions("zone", "bucket", "term", *order)
        placed.write.mode("overwrite").partitionBy("zone", "bucket").parquet(f"{folder}/{name}")

    spark = index.papers.sparkSession
    index.papers.select("peer", "urn", "title", "abstract", "resource_url").write.mode("overwrite").parquet(f"{folder}/papers")
    index.counts.write.mode("overwrite").parquet(f"{folder}/counts")
    index.frequencies.write.mode("overwrite").parquet(f"{folder}/frequencies")
    frequencies = spark.read.parquet(f"{folder}/frequencies")
    store(document_frequencies(frequencies, index.counts), "idf", "peer")
    idf = spark.read.parquet(f"{folder}/idf").drop("bucket")
    store(weigh(frequencies, idf), "postings", "peer", "urn")


def read_index(spark: SparkSession, folder: str) -> Index:
    """The index that ``write_index`` left."""
    t = {name: spark.read.parquet(f"{folder}/{name}") for name in ("papers", "counts", "frequencies", "idf", "postings")}
    return Index(t["papers"], t["counts"], t["frequencies"], t["idf"], t["postings"], bucketed=True)


def index_stats(frequencies: DataFrame) -> DataFrame:
    """(peer, zone, terms, papers, cells): dimensions of each term-by-document matrix."""
    per = frequencies.groupBy("peer", "zone").agg(F.count_distinct("term").alias("terms"), F.count_distinct("urn").alias("papers"))
    return per.withColumn("cells", F.col("terms") * F.col("papers"))


def matrix_rows(postings: DataFrame, pattern: str = "%.5f") -> DataFrame:
    """The dense term-by-document matrix of each peer and zone, one text line per term in order, its columns the papers in order.

    Only where a dense export is wanted: a row is as long as the peer has papers in the zone.
    """
    ids = postings.groupBy("peer", "zone").agg(F.sort_array(F.collect_set("urn")).alias("urns"))
    cells = postings.groupBy("peer", "zone", "term").agg(F.map_from_entries(F.collect_list(F.struct("urn", "weight"))).alias("cells"))
    value = lambda u: F.format_string(pattern, F.coalesce(F.element_at("cells", u), F.lit(0.0)))
    return cells.join(ids, ["peer", "zone"]).select("peer", "zone", "term", F.array_join(F.transform("urns", value), ",").alias("line"))


def vectors(postings: DataFrame) -> DataFrame:
    """(peer, zone, papers, terms): the sorted ids and terms of each matrix, comma-separated."""
    join = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return postings.groupBy("peer", "zone").agg(join("urn").alias("papers"), join("term").alias("terms"))
