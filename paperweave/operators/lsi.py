"""Latent structure of a zone: leading singular vectors of the whole document-by-term matrix, documents and terms in their space, and k-means of document vectors."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperweave.plans.runtime import cut_lineage


def numbered_terms(postings: DataFrame) -> DataFrame:
    """(term, id): all terms, numbered from 0 on in their order, without bringing them together."""
    terms = cut_lineage(postings.select("term").distinct().repartitionByRange("term").sortWithinPartitions("term"))
    placed = terms.withColumn("part", F.spark_partition_id()).withColumn("inner", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    # one row a partition
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return cut_lineage(placed.join(F.broadcast(offsets), "part").select("term", (F.col("offset") + F.col("inner")).alias("id")))


def singular_vectors(postings: DataFrame, k: int = 5) -> tuple[list[float], DataFrame]:
    """The k largest singular values of the matrix (peer, urn) by term of all weights, and (term, v): each term's components of the right singular vectors.

    The matrix stays distributed; the solver on the driver holds vectors of one number a term. Fewer values come back where the matrix has a lower rank.
    """
    ids = numbered_terms(postings)
    size = ids.count()
    cells = postings.where("weight <> 0").join(ids, "term").groupBy("peer", "urn").agg(F.sort_array(F.collect_list(F.struct("id", "weight"))).alias("cells"))
    vectors = cells.select(F.transform("cells", lambda c: c["id"]).alias("i"), F.transform("cells", lambda c: c["weight"]).alias("w")).rdd.map(lambda r: Vectors.sparse(size, r.i, r.w))
    vectors.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = RowMatrix(vectors, numCols=size).computeSVD(min(k, size))
        values, v = [float(s) for s in found.s], found.V.toArray()
    finally:
        vectors.unpersist()
    spark = postings.sparkSession
    components = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id bigint, v array<double>")
    return values, ids.join(components, "id").select("term", "v")


def documents_in_space(postings: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(peer, urn, coordinates): documents projected on the singular vectors, that is the left vectors times the singular values."""
    sums = [F.sum(F.col("weight") * F.col("v")[i]) for i in range(k)]
    return postings.join(terms, "term").groupBy("peer", "urn").agg(F.array(*sums).alias("coordinates"))


def latent_similarities(coordinates: DataFrame, queries: DataFrame) -> DataFrame:
    """(peer, urn_a, urn_b, sim): the rank-k product of the matrix with its own transpose, V S^2 V^T in the terms of a term-by-document matrix, for the documents
    named in ``queries`` (peer, urn) and all others of their peer."""
    a = coordinates.join(queries.select("peer", "urn"), ["peer", "urn"], "left_semi").select("peer", F.col("urn").alias("urn_a"), F.col("coordinates").alias("x"))
    b = coordinates.select("peer", F.col("urn").alias("urn_b"), F.col("coordinates").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    return a.join(b, "peer").where("urn_a <> urn_b").select("peer", "urn_a", "urn_b", dot.alias("sim"))


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """(vec_id, neighbour, sim, place): the k most similar vectors of each query, by cosine; ``queries`` is a small stated set, sent to all tasks."""
    cosine = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    unit = lambda df: df.withColumn("length", F.sqrt(cosine(F.col("embedding"), F.col("embedding"))))
    q = unit(queries).select("vec_id", F.col("embedding").alias("q"), F.col("length").alias("ql"))
    v = unit(vectors).select(F.col("vec_id").alias("neighbour"), "embedding", "length")
    pairs = v.join(F.broadcast(q), F.col("vec_id") != F.col("neighbour")).select("vec_id", "neighbour", (cosine(F.col("q"), F.col("embedding")) / (F.col("ql") * F.col("length"))).alias("sim"))
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc(F.round("sim", 9)), "neighbour"))
    return pairs.withColumn("place", place).where(F.col("place") <= k)


def group_vectors(vectors: DataFrame, k: int = 10, seed: int = 1) -> DataFrame:
    """(vec_id, cluster)"""
    features = vectors.select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed).fit(features)
    return model.transform(features).select("vec_id", F.col("prediction").alias("cluster"))


def document_similarities(postings: DataFrame, queries: DataFrame, zone: str = "abstract") -> DataFrame:
    """(peer, urn_a, urn_b, sim): cosines of the documents named in ``queries`` (peer, urn) with all others of their peer that share a term."""
    own = postings.where(F.col("zone") == zone).select("peer", "urn", "term", "weight")
    asked = own.join(queries.select("peer", "urn"), ["peer", "urn"], "left_semi").select("peer", "term", F.col("urn").alias("urn_a"), F.col("weight").alias("wa"))
    return asked.join(own, ["peer", "term"]).where("urn_a <> urn").groupBy("peer", "urn_a", F.col("urn").alias("urn_b")).agg(F.sum(F.col("wa") * F.col("weight")).alias("sim"))


