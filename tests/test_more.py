"""Smaller operators that no query shows by itself."""

from pyspark.sql import functions as F

from paperweave.functions import text as T
from paperweave.operators import corpus, graph, index, present, search, social
from paperweave.streaming import peers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_helpers(spark):
    assert one(spark, T.uptime(F.lit(93784))) == "1 days, 02:03:04 s"
    assert one(spark, T.wrap_label(F.lit("A very long title of a paper on caches"))) == "A very long\\ntitle of a..."
    assert one(spark, T.title_case_if_upper(F.lit("ON CACHES"))) == "On Caches" and one(spark, T.title_case_if_upper(F.lit("On CACHES"))) == "On CACHES"
    assert one(spark, T.expand_ligatures(F.lit("eﬃcient ﬁlms ﬂow oﬀ"))) == "efficient films flow off"
    assert one(spark, T.trim_all(F.lit('("word");:.'))) == "word"
    assert one(spark, T.split_hyphens(F.array(F.lit("peer-to-peer"), F.lit("x")))) == ["peer", "to", "peer", "x"]
    assert one(spark, present.term_column(F.lit("abc"))) == "abc" + " " * 17


def test_xml_both_ways(spark):
    columns = "query_id string, peer string, result_rank int, urn string, title string, authors array<string>, abstract string, resource_url string, score double, pagerank double, cited_by bigint"
    rows = spark.createDataFrame([("q", "p", 1, "u 1", "A <b> & c", ["X", "Y"], None, "file:///a.pdf", 0.4567, -1.0, 0)], columns)
    r = present.read_results(present.result_xml(rows)).first()
    assert (r.urn, r.title, r.authors, r.similarity, r.cited_by, r.resource) == ("u1", "A <b> & c", "X, Y", "VSM similarity ~45% (0.457)", None, "file:///a.pdf")
    xml = "<citation><title>Cats & dogs</title><authors><author>A. B</author><author>C. D</author></authors><date>2001</date></citation>"
    f = one(spark, present.read_reference_xml(F.lit(xml)))
    assert (f.title, f.authors.author, f.date, f.pages) == ("Cats and dogs", ["A. B", "C. D"], "2001", None)


def test_tag_cloud(spark):
    rows = spark.createDataFrame([("p", "a", 0.2), ("p", "b", 0.4), ("p", "c", 0.7), ("q", "x", 0.5), ("q", "y", 0.5)], "peer string, term string, weight double")
    assert [(r.term, r.font) for r in present.tag_cloud(rows).orderBy("term").collect()] == [("a", 6), ("b", 14), ("c", 26)]


def test_matrix_and_postings_files(spark, tmp_path):
    papers = spark.createDataFrame([("p", "a", "red cache", None, None, None), ("p", "b", "blue cache", None, None, None)], "peer string, urn string, title string, abstract string, body string, resource_url string")
    made = index.build_index(papers, ("title",))
    lines = {r.term: r.line for r in index.matrix_rows(made.postings).collect()}
    assert lines == {"red": "1.00000,0.00000", "blue": "0.00000,1.00000", "cache": "0.00000,0.00000"}
    index.write_index(made, str(tmp_path / "index"))
    stored = index.read_index(spark, str(tmp_path / "index"))
    for name in ("postings", "idf"):
        assert sorted(map(tuple, getattr(stored, name).drop("bucket").select(sorted(getattr(made, name).columns)).collect())) == sorted(map(tuple, getattr(made, name).select(sorted(getattr(made, name).columns)).collect()))
    few = stored.narrowed(("title",), ["red", "nowhere"]).postings
    plan = few._jdf.queryExecution().toString()
    assert [r.urn for r in few.collect()] == ["a"] and "PartitionFilters: [isnotnull(zone" in plan and "bucket" in plan and "PushedFilters: [In(term" in plan
    stats = index.index_stats(made.frequencies).first()
    assert (stats.terms, stats.papers, stats.cells) == (3, 2, 6)


def test_citing_papers_and_self_citations(spark):
    papers = spark.createDataFrame([("p", u) for u in "abc"], "peer string, urn string")
    citations = spark.createDataFrame([("p", "a", "b"), ("p", "a", "b"), ("p", "b", "b"), ("p", "a", "zz"), ("q", "c", "b")], "peer string, citing_urn string, cited_urn string")
    assert {tuple(r) for r in search.citing_papers(citations, "b").collect()} == {("p", "a"), ("p", "b"), ("q", "c")}
    assert search.citing_papers(citations, "nobody").count() == 0
    assert graph.edges_of(citations, papers).count() == 1 and graph.edges_of(citations, papers, self_citations=True).count() == 2


def test_gossip(spark):
    assert social.gossip_traffic(30) == 7200 and social.gossip_traffic(30, 1, 1) == 2400
    rows = [(p, t, 1.0 + i / 10) for i, (p, ts) in enumerate({"a": "xy", "b": "xz", "c": "yz", "d": "xyz"}.items()) for t in ts]
    similar = social.similarities(spark.createDataFrame(rows, "peer string, term string, weight double"))
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "peer string, buddy string")
    central = {(r.peer, r.buddy) for r in social.buddies(similar).collect()}
    assert {(r.peer, r.buddy) for r in social.gossip_neighbours(similar, ring).collect()} == central


def test_peers(spark):
    t = lambda s: f"2009-01-01 00:{s}"
    rows = [("a", "h", "join", t("00:00")), ("a", "h", "heartbeat", t("00:30")), ("a", "h", "heartbeat", t("05:00")), ("a", "other", "join", t("09:00")), ("b", "h", "join", t("00:10")), ("b", "h", "leave", t("00:20")), (None, "h", "join", t("00:00")), ("c", None, "join", t("01:00"))]
    events = spark.createDataFrame(rows, "peer string, address string, kind string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert {(r.peer, r.events) for r in peers.presence(events.where("peer = 'a'")).collect()} == {("a", 2), ("a", 1)}
    live = {r.peer: r.live for r in peers.live_at(events, t("01:00")).collect()}
    assert live == {"a": True, "b": False, "c": True}
    assert {(r.peer, r.port) for r in peers.ports(peers.registered(events)).collect()} == {("a", 16201), ("b", 16202)}


def test_zones(spark):
    papers = spark.createDataFrame([("p", "a", "T", None, ""), ("p", "b", None, "x", "y"), ("p", "a", "T", None, "")], "peer string, urn string, title string, abstract string, body string")
    known = corpus.known_papers(papers)
    assert [(r.urn, r.zone) for r in corpus.zones_of(known).collect()] == [("a", "title")]
