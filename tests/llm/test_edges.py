"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from paperweave.llm import clusters, distinctiveness, encoding, linkage, mixing, names, packing, scanned, subjects, term_counts
from paperweave.llm.tokens import count_tokens

LONG = "word " * 40_000 + "naïve cafÃ© betw-\neen "
SENTENCES = [
    "The cost of the cache falls sharply once mobile caches are available to all.",
    "A survey of forty routers reveals three kinds of partial overlay network failure.",
    "Each replica was observed over many weeks and scored against the best known peers.",
    "Limits of the quorum are discussed, among them its dependence on slow links.",
    "We close the gap between decentralised proxies and the adaptive broadcast round.",
]
ABSTRACT = " ".join(SENTENCES)
#: Columns named like the ones that the operators make on their way.
EXTRA = {c: "x" for c in ("term", "tf", "n", "key", "node", "word", "field", "records", "degree", "position", "place", "cluster", "share", "ref", "index_key", "form", "count", "text2", "urn2")}


def papers(spark, empty=False):
    rows = [
        ("p", "u1", "A title", ABSTRACT, "Body text"),
        ("p", "u1", "A title", ABSTRACT, "Body text"),
        ("q", "u2", None, ABSTRACT.replace("sharply", "quickly"), None),
        ("q", "u3", "", "", ""),
        (None, "u4", "Other", None, LONG),
        ("p", None, "No key", ABSTRACT, "x"),
        ("p", "u5", "12 34 ???", "!!! 55", "\n\n"),
        ("p", "u6", "A title", " ".join(reversed(SENTENCES)), "Body text"),
    ]
    df = spark.createDataFrame([] if empty else rows, "peer string, urn string, title string, abstract string, body string")
    df = df.withColumn("resource_url", F.lit(None).cast("string"))
    return df.withColumns({k: F.lit(v) for k, v in EXTRA.items()})


@pytest.mark.parametrize("empty", [False, True])
def test_terms(spark, empty):
    p = papers(spark, empty)
    got = {r.ngram: r for r in term_counts.mark_terms(p, "urn", ["abstract", "body"], max_terms=2).collect()}
    scored = distinctiveness.score_terms(p, "urn", ["title", "abstract"]).collect()
    if empty:
        assert not got and not scored
        return
    assert (got["word"].occurrences, got["word"].records, got["word"].mark) == (40_000, 1, "rare")
    assert got["body text"].records == 2 and "no key" not in got and got["cache falls"].occurrences == 3
    assert {r.urn for r in scored} == {"u1", "u2", "u4", "u6"}
    assert all(r.records <= 4 and r.degree >= 0 for r in scored)


@pytest.mark.parametrize("empty", [False, True])
def test_clusters(spark, empty):
    made = clusters.Clustering(papers(spark, empty), "urn", "abstract")
    pairs = {tuple(r) for r in clusters.pairs(made.clusters()).collect()}
    assert pairs == (set() if empty else {("u1", "u2"), ("u1", "u6"), ("u2", "u6")})
    described = made.described().collect()
    assert [(r.size, len(r.typical)) for r in described] == ([] if empty else [(3, 3)])


@pytest.mark.parametrize("empty", [False, True])
def test_encoding(spark, empty):
    p = papers(spark, empty).withColumn("abstract", F.when(F.col("urn") == "u4", LONG).otherwise(F.col("abstract")))
    got = {(r.urn, r.field): r.restored for r in encoding.restore(p, "urn", ["title", "abstract"]).collect()}
    assert set(got) == (set() if empty else {("u4", "abstract")})
    assert empty or "naïve café betw" in got["u4", "abstract"]


@pytest.mark.parametrize("empty", [False, True])
def test_scanned(spark, empty):
    scan = scanned.Scan(papers(spark, empty), "urn", ["abstract", "body"], ratio=2)
    got = {(r.key, r.field) for r in scan.damage().collect()}
    assert got == (set() if empty else {("u4", "body")})
    repaired = scan.repaired().collect()
    assert empty or "between" in repaired[0].repaired


@pytest.mark.parametrize("empty", [False, True])
def test_names(spark, empty):
    rows = ["Anna Berglund", "Anna Berglund", "BERGLUND, Anna", "A. Berglund", "Dr. Anna Berglund", "Anna Bergulnd", "", " ", "?!", None, "x" * 5000, "Bo Lind", "Bo Lind*", "The Vega Group", "Vega group"]
    df = spark.createDataFrame([] if empty else [(r,) for r in rows], "author_name string").withColumns({k: F.lit(v) for k, v in EXTRA.items()})
    pairs = {tuple(r) for r in names.spelling_pairs(names.link_names(df)).collect()}
    if empty:
        assert not pairs
        return
    anna = sorted(r for r in set(rows) if r and "erg" in r.lower())
    assert pairs == {(a, b) for a in anna for b in anna if a < b} | {("Bo Lind", "Bo Lind*"), ("The Vega Group", "Vega group")}


@pytest.mark.parametrize("empty", [False, True])
def test_links(spark, empty):
    p = papers(spark, empty).withColumn("title", F.when(F.col("urn") == "u6", "Adaptive broadcast rounds without decentralised proxies").otherwise(F.col("title")))
    authors = spark.createDataFrame([] if empty else [("u6", 1, "Anna Berglund"), ("u6", 1, "Anna Berglund"), ("u6", None, None), (None, 1, "x")], "urn string, author_pos int, author_name string").withColumn("peer", F.lit("p"))
    refs = [
        ("p", "c", 1, "[1] A. Berglund, “Adaptive broadcast rounds without decentralised proxies,” in Proc. X, 2001.", None, None),
        ("p", "c", 1, "[1] A. Berglund, “Adaptive broadcast rounds without decentralised proxies,” in Proc. X, 2001.", None, None),
        ("p", "c", 2, None, None, None),
        ("q", "c", 3, "[1] A. Berglund, “Adaptive broadcast rounds without decentralised proxies,” in Proc. X, 2001.", None, "u6"),
        (None, "c", 4, "", "", None),
        ("p", None, None, LONG, LONG, None),
        ("p", "c", 5, LONG, "", None),
    ]
    references = spark.createDataFrame([] if empty else refs, "peer string, citing_urn string, ref_pos int, raw string, title string, cited_urn string").withColumn("pub_date", F.lit(None).cast("string")).withColumn("shared", F.lit(1))
    got = {(r.citing_urn, r.ref_pos, r.cited_urn): r.confidence for r in linkage.link(references, p, authors).collect()}
    assert (set() if empty else {("c", 1, "u6")}) <= set(got) and not any(k[1] == 3 for k in got)


@pytest.mark.parametrize("empty", [False, True])
def test_packing(spark, empty):
    rows = [(1, "a b c"), (2, None), (3, ""), (4, LONG), (5, "same text"), (5, "same text"), (6, "same text")]
    df = spark.createDataFrame([] if empty else rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in EXTRA.items()})
    measured = packing.measure(df)
    placed = packing.pack(measured, 1000).collect()
    if empty:
        assert not placed
        return
    filled = {}
    for r in placed:
        filled[r.container] = filled.get(r.container, 0) + r.n_tokens
    assert max(filled.values()) <= 1000 and sum(filled.values()) == measured.agg(F.sum("n_tokens")).first()[0]
    assert sorted(r.key for r in placed if r.part == 0) == [1, 2, 3, 4, 5, 5, 6]
    assert {r.key for r in placed if r.part > 0} == {4}
    with pytest.raises(ValueError):
        packing.pack(measured, 0)


@pytest.mark.parametrize("empty", [False, True])
def test_mixing(spark, empty):
    rows = [(i, "a", "one two three four") for i in range(40)] + [(100 + i, "b", "one two") for i in range(3)] + [(200, None, "x"), (201, "c", None), (202, "a", "")]
    df = spark.createDataFrame([] if empty else rows, "doc_id long, source string, text string").withColumns({k: F.lit(v) for k, v in EXTRA.items()})
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3), ("none", 0.0, 1), (None, 0.1, 1), ("c", None, None)], "source string, target_share double, max_passes int")
    sizes = count_tokens(df.select("doc_id", "source", "text"))
    assigned = mixing.assign(sizes, targets)
    report = {r.source: r for r in mixing.report(assigned, mixing.demands(sizes, targets)).collect()}
    assert set(report) == {"a", "b", "none", "c"}
    used = assigned.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("pass").alias("p")).collect()
    if empty:
        assert not used and all(r.full for r in report.values())
        return
    assert all(r.n == r.p <= 3 for r in used)
    assert report["a"].full and not report["b"].full and report["b"].reached == 18
    assert assigned.where("position < 0 or position >= 1").count() == 0
    # the curriculum: half of the tokens of a source of slope 0 are due in the first half, more of one with a falling weight
    a = assigned.where("source = 'a'")
    early = a.where("position < 0.5").agg(F.sum("n_tokens")).first()[0]
    assert 0.3 < early / report["a"].reached < 0.8


@pytest.mark.parametrize("empty", [False, True])
def test_subjects(spark, empty):
    art = "The painter mixed colours on the canvas. A gallery showed the painting of the sculptor. "
    sea = "The sailor steered the vessel into the harbour. A storm broke the mast of the ship. "
    rows = [(i, (art if i % 2 else sea) * 3) for i in range(60)] + [(100, art * 3 + sea * 3), (101, None), (102, ""), (103, "1 2 3"), (104, art * 2000)]
    df = spark.createDataFrame([] if empty else rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in EXTRA.items()})
    labels = spark.createDataFrame([] if empty else [(i, "art" if i % 2 else "sea") for i in range(40)] + [(None, "art"), (1, None), (999, "sea")], "doc_id long, subject string").withColumn("annotator", F.lit("r"))
    sample = subjects.sampled(labels)
    model = subjects.train(df, sample, spark.createDataFrame([("art", ""), ("sea", ""), (None, None)], "subject string, description string"))
    got = {}
    for r in subjects.classify(df, model, sample).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    if empty:
        assert not got
        return
    assert all(got[i] == {"art" if i % 2 else "sea"} for i in range(60))
    assert got[100] == {"art", "sea"} and got[104] == {"art"} and not {101, 102, 103} & set(got)
