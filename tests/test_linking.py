"""The linkers on tables on which comparing everything with everything would show."""

import pytest
from pyspark.sql import functions as F

from paperweave.functions import text as T
from paperweave.operators import graph, index, linking

PAPER = "peer string, urn string, title string, abstract string, body string, resource_url string"
REFERENCE = "peer string, citing_urn string, ref_pos int, title string, cited_urn string"


def rows_shuffled(spark, run):
    """What ``run`` gives, and how many rows the stages that it needed wrote for others."""
    sc = spark.sparkContext
    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    found = run()
    return found, sum(n for stage, n in written().items() if stage not in before)


@pytest.fixture(scope="module")
def crowd(spark):
    """600 papers of one peer with two words in common, and references to every second one."""
    name = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:04d}")
    papers = [("p", f"u{i:04d}", f"network study {name(i)}", f"a network for {name(i + 1)}", None, None) for i in range(600)]
    references = [("p", f"c{i:04d}", 1, f"Network study: {name(i)}.", "x" if i % 4 else None) for i in range(0, 600, 2)]
    references += [("p", f"c{i:04d}", 2, f"network study of something {i}", None) for i in range(300)]
    return index.build_index(spark.createDataFrame(papers, PAPER)), spark.createDataFrame(references, REFERENCE)


OPTIONS = {
    "graph_counters": {"unresolved_only": True},
    "link_citations_gated": {"alpha": 0.95, "least_score": 0.20},
    "link_citations_oldest": {"k": 3, "least_score": 0.40},
    "link_citations_incremental": {"unresolved_only": True},
    "link_citations": {},
}


@pytest.mark.parametrize("query", OPTIONS)
def test_common_words_do_not_pair_all_references_with_all_papers(spark, crowd, query):
    papers, references = crowd
    links = lambda: linking.link_citations(papers, references, **OPTIONS[query])
    if query == "graph_counters":
        (row,), rows = rows_shuffled(spark, lambda: graph.graph_counters(references, links()).collect())
        assert (row.strings_analysed, row.edges_added) == (450, 150)
    else:
        found, rows = rows_shuffled(spark, lambda: links().collect())
        asked = range(0, 600, 4) if "unresolved_only" in OPTIONS[query] else range(0, 600, 2)
        assert {(r.citing_urn, r.ref_pos, r.cited_urn) for r in found} == {(f"c{i:04d}", 1, f"u{i:04d}") for i in asked}
    assert rows < 100_000


def test_a_paper_that_only_its_abstract_ranks_higher_counts_among_the_best(spark):
    # the title of "far" is within the reference but holds no index term, so five papers with the reference's words in the abstract come before it
    papers = [("p", "far", "1 2", "tree", None, None)] + [("p", f"n{i}", f"other {'xyzuv'[i]}q", "caches tree", None, None) for i in range(5)] + [("p", "w", "wholly different", "nothing", None, None)]
    made = index.build_index(spark.createDataFrame(papers, PAPER))
    references = spark.createDataFrame([("p", "c", 1, "1 2 tree caches", None)], REFERENCE)
    assert linking.link_citations(made, references).count() == 0
    assert [r.cited_urn for r in linking.link_citations(made, references, k=6).collect()] == ["far"]


def test_nearest_titles_are_those_that_brute_force_finds(spark):
    import random

    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdeß é") for _ in range(draw.randint(1, 9)))
    titles = [" ".join(word() for _ in range(draw.choice((1, 3, 9, 16)))) for _ in range(60)]
    slips = lambda t: "".join(draw.choice(("", c + "x", "y")) if draw.random() < 0.15 else c for c in t)
    papers = spark.createDataFrame([("pq"[i % 2], f"u{i % 50}{i}", t) for i, t in enumerate(titles)], "peer string, urn string, title string")
    references = spark.createDataFrame([("pqr"[i % 3], "c", i, slips(draw.choice(titles))) for i in range(90)], "peer string, citing_urn string, ref_pos int, title string")
    got = {r.ref_pos: (r.distance, r.cited_urn) for r in linking.link_by_edit_distance(papers, references).collect()}
    want = {}
    for r in references.join(papers.select("peer", "urn", F.col("title").alias("t")), "peer").withColumn("d", T.edit_distance(F.col("title"), F.col("t"))).where("d < 15").collect():
        want[r.ref_pos] = min(want.get(r.ref_pos, (99, "")), (r.d, r.urn))
    assert got == want and len(want) > 20


def test_titles_of_the_same_letters_are_compared_without_a_row_for_each_length(spark):
    # 700 titles that letter counts don't tell apart; they were dealt by every length that may meet theirs
    letters = list("abcdefghijklmnopqrstuvwxyzabcdefghijklmnop")
    import random

    draw = random.Random(7)
    mixed = ["".join(draw.sample(letters, len(letters))) for _ in range(700)]
    papers = spark.createDataFrame([("p", f"u{i:03d}", t) for i, t in enumerate(mixed)], "peer string, urn string, title string")
    references = spark.createDataFrame([("p", "c", i, t[1:] + "!") for i, t in enumerate(mixed)], "peer string, citing_urn string, ref_pos int, title string")
    found, rows = rows_shuffled(spark, lambda: linking.link_by_edit_distance(papers, references).collect())
    assert {(r.ref_pos, r.cited_urn, r.distance) for r in found} == {(i, f"u{i:03d}", 2) for i in range(700)}
    assert rows < 15_000
