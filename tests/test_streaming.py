from pyspark.sql import functions as F

from paperweave.operators import profiles
from paperweave.operators.index import build_index
from paperweave.plans.queries import QUERIES
from paperweave.plans.runtime import distinct_by, read_table
from paperweave.sources import files
from paperweave.streaming.ingest import Collection
from tests.compare import DATA


def test_ingesting_in_batches_equals_one_batch(spark, tmp_path):
    papers = read_table(spark, DATA, "papers").cache()
    source = tmp_path / "in"
    papers.repartition(3).write.parquet(str(source))
    made = Collection(spark, str(tmp_path / "out"))
    stream = spark.readStream.schema(papers.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    made.follow(stream, str(tmp_path / "checkpoint")).awaitTermination()
    batch = profiles.top_terms(profiles.centroid(build_index(papers).postings))
    rows = lambda df: sorted((r.peer, r.term, round(r.weight, 9)) for r in df.collect())
    assert rows(spark.read.parquet(made.path("profiles"))) == rows(batch)
    assert spark.read.parquet(made.path("papers")).count() == distinct_by(papers, "peer", "urn").count()
    assert made.neighbours().count() > 0


def test_directory_scan_and_insert(spark, tmp_path):
    (tmp_path / "a.b.pdf").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"y")
    found = files.scan_directory(spark, str(tmp_path), checksum=True).collect()
    assert [(r.resource_key, r.sha1) for r in found] == [("a.b", "11f6ad8ec52a2984abaafd7c3b516503785c2072")]
    new = spark.createDataFrame([("k", 1), ("k", 2), ("m", 3)], "key string, v int")
    files.insert_if_absent(new, str(tmp_path / "t"), "key")
    files.insert_if_absent(new, str(tmp_path / "t"), "key")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_ingest_links_ranks_and_recommends(spark, tmp_path):
    few = ["mirelo", "norrin", "brasca", "abrolo"]
    papers = spark.read.parquet(f"{DATA}/papers.parquet").select("peer", "urn", "title", "abstract", "body", "resource_url").where(F.col("peer").isin(few))
    references = spark.read.parquet(f"{DATA}/bib_refs.parquet").where("title is not null").select("peer", "citing_urn", "ref_pos", "title", "cited_urn").where(F.col("peer").isin(few))
    collection = Collection(spark, str(tmp_path))
    for own in (few[:1], few[1:]):
        collection.ingest(papers.where(F.col("peer").isin(own)), references.where(F.col("peer").isin(own)))
    for table, query, columns in (("ranks", "build_and_analyse", ("peer", "urn")), ("links", "link_citations", ("peer", "citing_urn", "ref_pos", "cited_urn")), ("counters", "graph_counters", ("peer", "edges_added"))):
        got = spark.read.parquet(collection.path(table)).select(*columns)
        wanted = QUERIES[query](spark, DATA).where(F.col("peer").isin(few)).select(*columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    assert collection.recommendations().count() > 0
