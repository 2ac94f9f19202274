"""Worked examples and fixtures with known results."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperweave.functions import porter
from paperweave.functions import text as T
from paperweave.operators import evaluate, extract, graph, index, linking, profiles, search, social
from paperweave.operators.components import connected_components

EDGES_57 = """2>1 2>57 4>1 6>1 6>57 7>1 7>17 7>57 8>1 8>4 9>1 10>1 10>3 11>1 12>1 13>1 14>1 14>21 16>1 16>6 16>57 17>1 17>56 19>1 19>57 20>1 20>15 21>1 22>1 22>57 23>1 26>1 27>1
28>1 29>1 30>5 30>56 31>30 33>30 33>56 34>30 35>30 36>15 36>30 37>30 37>57 38>30 38>31 39>30 40>54 41>30 41>36 42>30 43>30 44>30 45>30 47>30 47>57 48>30 50>30 51>30 51>57 53>30 53>47 55>30 55>31"""
RANKS_57 = """1:0.1460/7 2:0.0093/1 3:0.0132/2 4:0.0132/2 5:0.0662/6 6:0.0119/2 15:0.0189/3 17:0.0119/2 18:0.0093/1 21:0.0132/2 30:0.1339/7 31:0.0172/3 36:0.0132/2 47:0.0132/2 54:0.0172/3 56:0.0753/6 57:0.0450/5"""


def graph_of(spark, text, nodes):
    edges = spark.createDataFrame([("p", *e.split(">")) for e in text.split()], "peer string, citing_urn string, cited_urn string")
    return spark.createDataFrame([("p", str(n)) for n in nodes], "peer string, urn string"), edges


def test_tfidf_example(spark):
    held = {"content": [2, 5], "network": [1, 3, 4], "overlay": [1, 2, 3], "peer-to-peer": [3, 4, 5, 6], "semantic": [1, 2, 3, 6]}
    docs = {d: " ".join(t for t, ds in held.items() if d in ds) for d in range(1, 7)}
    papers = spark.createDataFrame([("p", f"d{d}", t, None, "", None) for d, t in docs.items()], "peer string, urn string, title string, abstract string, body string, resource_url string")
    made = index.build_index(papers)
    w = {(r.urn, r.term): r.weight for r in made.postings.collect()}
    expected = {("d1", "network"): 0.653, ("d1", "semantic"): 0.382, ("d2", "content"): 0.807, ("d3", "overlay"): 0.610, ("d4", "peer-to-peer"): 0.505, ("d5", "content"): 0.938, ("d6", "semantic"): 0.707}
    for k, v in expected.items():
        assert w[k] == pytest.approx(v, abs=6e-4)
    # a term twice in the query counts twice in the query's length and in the score; unknown terms are harmless
    q = search.make_queries(spark, {"one": "network overlay", "two": "network network", "none": "nowhere", "empty": ""})
    got = {(r.query_id, r.urn): r.score for r in search.score_zones(made, q, {"title": 1.0}).collect()}
    idf = math.log(6 / 3)
    length = math.sqrt(2 * (2 * idf) ** 2)
    assert got["two", "d4"] == pytest.approx(2 * w["d4", "network"] * 2 * idf / length)
    assert not any(k[0] in ("none", "empty") for k in got)
    assert max(v for k, v in got.items() if k[0] == "one") <= 1 + 1e-9


def test_term_in_every_paper_scores_zero_and_is_kept(spark):
    papers = spark.createDataFrame([("p", u, "common", None, None, None) for u in "ab"], "peer string, urn string, title string, abstract string, body string, resource_url string")
    made = index.build_index(papers)
    rows = search.search(made, search.make_queries(spark, {"q": "common"}), {"title": 1.0}).orderBy("result_rank").collect()
    assert [(r.urn, r.score) for r in rows] == [("a", 0.0), ("b", 0.0)]
    enriched = search.enrich(search.search(made, search.make_queries(spark, {"q": "common"}), {"title": 1.0}), made.papers, spark.createDataFrame([("p", "a", 0.5)], "peer string, urn string, rank double"))
    assert {r.urn: r.pagerank for r in enriched.collect()} == {"a": 0.5, "b": -1.0}


def test_ranks_of_57_papers(spark):
    nodes, edges = graph_of(spark, EDGES_57, range(1, 58))
    ranks = graph.pagerank(nodes, edges)
    got = {r.urn: r for r in graph.color_scale(ranks).collect()}
    for item in RANKS_57.split():
        node, _, rest = item.partition(":")
        rank, _, color = rest.partition("/")
        assert got[node].rank == pytest.approx(float(rank), abs=6e-5)
        assert got[node].color == int(color)
    assert sum(r.rank for r in got.values()) == pytest.approx(1, abs=1e-9)


def test_four_nodes_and_a_cycle(spark):
    nodes, edges = graph_of(spark, "a>b b>c c>a c>b", "abcd")
    got = {r.urn: r.rank for r in graph.pagerank(nodes, edges, alpha=0.8, convergence=1.0).collect()}
    assert {k: round(v, 3) for k, v in got.items()} == {"a": 0.206, "b": 0.371, "c": 0.360, "d": 0.063} or got["d"] == pytest.approx(0.0625, abs=1e-3)
    ring = graph_of(spark, "1>2 2>3 3>4 4>1", "1234")
    for walk in (graph.pagerank(*ring), graph.dense_pagerank(*ring, times=5)):
        assert all(r.rank == pytest.approx(0.25) for r in walk.collect())
    with pytest.raises(ValueError):
        graph.dense_pagerank(nodes, edges)


def test_empty_graph(spark):
    nodes, edges = graph_of(spark, "a>b", "")
    nodes = spark.createDataFrame([], "peer string, urn string")
    assert graph.pagerank(nodes, edges.where("false")).count() == 0


def test_measures(spark):
    cases = [(39, 2, 43, 3165, 0.95, 0.48, 0.63, 0.99), (64, 2, 4, 3179, 0.97, 0.94, 0.96, 1.00), (64, 2, 19, 3164, 0.97, 0.77, 0.86, 0.99)]
    df = spark.createDataFrame(cases, "tp int, fp int, fn int, tn int, p double, r double, f1 double, a double")
    m = evaluate.measures(*map(F.col, ("tp", "fp", "fn", "tn")))
    for r in df.withColumns(m).collect():
        assert (r.precision, r.recall, r.f, r.accuracy) == pytest.approx((r.p, r.r, r.f1, r.a), abs=0.01)


def test_distances(spark):
    pairs = [("ANT", "AUNT", 1, None), ("GUMBO", "GAMBOL", 2, None), ("GUMBO", "", 5, None), ("spam", "ham", 2, None), ("spam", "SPAM", 0, 0), ("SUPER", "DUPER", 1, 1), ("STEM", "SPAM", 2, 2)]
    df = spark.createDataFrame(pairs, "a string, b string, l int, h int")
    for r in df.select("*", T.edit_distance(F.col("a"), F.col("b")).alias("x"), T.hamming_distance(F.col("a"), F.col("b")).alias("y")).collect():
        assert r.x == r.l and r.y == r.h
    one = df.where("b = 'SPAM' and a = 'spam'").select(T.edit_distance(F.col("a"), F.col("b"), True).alias("x"), T.hamming_distance(F.col("a"), F.col("b"), True).alias("y")).first()
    assert (one.x, one.y) == (4, 4)


def test_edit_distance_links_find_what_brute_force_finds(spark):
    titles = ["On the cost of caches", "On the cost of cashes and more", "Völlig anders", "x"]
    refs = ["on the coost of caches", "vollig anders", "nothing of the kind, and long", None]
    papers = spark.createDataFrame([("p", f"u{i}", t) for i, t in enumerate(titles)], "peer string, urn string, title string")
    references = spark.createDataFrame([("p", "c", i, t) for i, t in enumerate(refs)], "peer string, citing_urn string, ref_pos int, title string")
    got = {r.ref_pos: (r.cited_urn, r.distance) for r in linking.link_by_edit_distance(papers, references).collect()}
    brute = references.join(papers.select("peer", "urn", F.col("title").alias("t")), "peer").withColumn("d", T.edit_distance(F.col("title"), F.col("t"))).where("d < 15")
    want = {}
    for r in brute.collect():
        want[r.ref_pos] = min(want.get(r.ref_pos, (99, "z")), (r.d, r.urn))
    assert got == {k: (u, d) for k, (d, u) in want.items()}


def test_stems():
    first_step = dict(caresses="caress", ponies="poni", ties="ti", cats="cat", feed="feed", agreed="agree", disabled="disable", matting="mat", mating="mate", meeting="meet", milling="mill", messing="mess", meetings="meet")
    assert {w: porter._plurals_and_participles(w) for w in first_step} == first_step
    assert [porter.stem(w) for w in ("relational", "generalization", "oscillators", "sky", "at", "", None)] == ["relat", "gener", "oscil", "sky", "at", "", None]


def test_tokens(spark):
    df = spark.createDataFrame([("[computer-communication e-mail attacks” 2nd karger@kargerch -left right- a1 b (the) Frequency/voltage? it's",), (None,), ("",)], "text string")
    got = [r.term for r in T.explode_terms(df, "text").collect()]
    assert got == ["[computer-communication", "e-mail", "attacks”", "2nd", "karger@kargerch", "left", "right", "frequency/voltage"]
    trimmed = spark.createDataFrame([(w,) for w in ("end.", "a;b;", "(abc)", "(ab1", "x)", "y:", "z,", "plain")], "w string").select(T.trim_reference_token(F.col("w")).alias("w"))
    assert [r.w for r in trimmed.collect()] == ["end", "ab", "abc", "ab1", "x", "y", "z", "plain"]


def test_references_are_cut():
    entries = ["[1] http://a.example/x", "[2] http://b.example/y"] + [f"[{i}] A. Writer. A title of some kind number {i}. In Proc. of X, pages 1-9, 2001." for i in range(3, 9)]
    assert len(extract.split_references(" ".join(entries))) == 8
    assert extract.split_references("[1] only one") == []
    assert extract.split_references("[1] a [2] b  1. Aa  2. Bb") == []
    assert len(extract.split_references("[1] short [2] " + "x" * 351 + " [3] c")) == 1
    assert extract.split_references("[100] a [101] b") == [] and extract.split_references(None) == []


def test_author_lines():
    assert extract.author_names("Anna Smith, Bob C. Jones and Carla Diaz") == ["Anna Smith", "Bob C. Jones", "Carla Diaz"]
    for line in ("Anna Smith 3", "a@b.c", "University of Somewhere", "anna smith", "Smith", None):
        assert extract.author_names(line) == []


LAYOUT = """<!-- .ft0{font-size:24px;} .ft1{font-size:14px;} .ft2{font-size:11px;} --><!-- Page 1 -->
<div style="position:absolute;top:90;left:80"><span class="ft0">A STUDY OF CACHES</span></div>
<div style="position:absolute;top:150;left:80"><span class="ft1">Anna Smith, Bob Jones</span></div>
<div style="position:absolute;top:300;left:80"><span class="ft2">Abstract We show a distri-</span></div>
<div style="position:absolute;top:320;left:80"><span class="ft2">buted cache.</span></div>
<div style="position:absolute;top:400;left:80"><span class="ft2">Introduction Caches are everywhere. Conclusion none.</span></div>
<div style="position:absolute;top:900;left:80"><span class="ft2">References</span></div>
<div style="position:absolute;top:920;left:80"><span class="ft2">[1] A. One. First. [2] B. Two. Second.</span></div>"""


def test_layout(spark):
    got = extract.parse_documents(spark.createDataFrame([("d", LAYOUT), ("e", "<p>a shopping list</p>"), ("n", None)], "doc_id string, html string")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.title, r.authors, r.abstract) == ("A Study Of Caches", ["Anna Smith", "Bob Jones"], "We show a distributed cache.")
    assert "everywhere" in r.body and len(extract.split_references(r.reference_text)) == 2


def test_profile_prefix_stops_at_the_term_that_completes_the_stems(spark):
    rows = [("p", t, w) for t, w in (("network", 0.9), ("networks", 0.8), ("cache", 0.7), ("query", 0.6), ("caches", 0.5))]
    kept = {r.term for r in profiles.stemmed_terms(spark.createDataFrame(rows, "peer string, term string, weight double"), 2).collect()}
    assert kept == {"network", "networks", "cache"}


def test_neighbours_are_strict_and_alphabetical(spark):
    rows = [("a", "x", 1.0), ("b", "x", 1.0), ("c", "x", 1.0), ("d", "x", 1.0), ("e", "y", 1.0), ("z", "x", 0.0)]
    chosen = social.buddies(social.similarities(spark.createDataFrame(rows, "peer string, term string, weight double"))).collect()
    assert {(r.peer, r.buddy) for r in chosen if r.peer == "d"} == {("d", "a"), ("d", "b")}
    assert not any(r.peer in "ez" or r.buddy in "ez" for r in chosen)


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (5, 5), (2000, 2000)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert {got[i] for i in range(n + 1)} == {0} and got[1001] == 1000 and got[2000] == 2000
    assert connected_components(edges.where("false")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abcde fghij network systems caching caches".split()), max_size=8))
def test_stemming_is_lower_case_and_short(words):
    assert all(len(porter.stem(w)) <= len(w) + 1 for w in words)


def test_hamming_distance_of_unequal_lengths(spark):
    import pytest

    df = spark.createDataFrame([("abc", "abd"), ("abc", "ab"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(T.hamming_distance(F.col("a"), F.col("b"))).collect()] == [1, None, None]
    with pytest.raises(Exception, match="unequal length"):
        df.select(T.hamming_distance(F.col("a"), F.col("b"), strict=True)).collect()


def test_old_tokens(spark):
    df = spark.createDataFrame([("The Graph, (a) of models;  x.",)], "t string")
    assert df.select(T.old_tokens(F.col("t"))).first()[0] == ["graph", "models", "", "x"]
