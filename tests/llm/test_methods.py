"""The methods by themselves: brute force, round trips, planted structure."""

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperweave.llm import clusters, encoding, linkage, names, packing, scanned, subjects, term_counts
from paperweave.llm.queries import QUERIES, SQL
from paperweave.plans.runtime import read_table
from tests.compare import DATA, same


def test_queries_against_sql(spark):
    for name, sql in SQL.items():
        same(spark, QUERIES[name], sql)


def test_every_query_runs(spark):
    for name in sorted(set(QUERIES) - set(SQL)):
        df = QUERIES[name](spark, DATA)
        assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_ngram_counts_against_brute_force(spark):
    texts = ["aaa bbb aaa bbb ccc", "bbb aaa", "aaa aaa aaa aaa", "ccc", ""]
    df = spark.createDataFrame([(str(i), t, t[::-1]) for i, t in enumerate(texts)], "k string, a string, b string")
    seen, held = Counter(), Counter()
    for t in texts:
        own = Counter()
        for f in (t, t[::-1]):
            w = f.split()
            own.update(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
        seen.update(own)
        held.update(own.keys())
    got = {r.ngram: (r.occurrences, r.records) for r in term_counts.count_ngrams(df, "k", ["a", "b"], 3, spread=3).collect()}
    assert got == {k: (seen[k], held[k]) for k in seen}


def test_hilbert_curve_visits_neighbours():
    side = 8
    grid = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(side**3))
    assert np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1).max() == 1


def test_packing_wastes_little(spark):
    documents = read_table(spark, "/root/testdata/sf0.01", "documents")
    placed = packing.pack(packing.measure(documents), 2048)
    r = placed.agg(F.sum("n_tokens").alias("tokens"), F.count_distinct("container").alias("containers")).first()
    assert r.tokens / 2048 / r.containers > 0.95


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdeéèüößñçÉÜ", min_size=2, max_size=8).filter(lambda w: not w.isascii()), st.sampled_from(["utf-8>cp1252", "utf-8>latin-1", "utf-8>mac_roman", "utf-8>cp437", "utf-8>latin-1>utf-8>cp1252"]))
def test_garbling_is_undone_by_characters(word, chain):
    original = encoding._by_characters(encoding.garble(word, chain))
    assert original is not None and original[0] == word or encoding.odd(word)


def test_planted_garbling_is_found_and_restored(spark):
    clean = ["Größen der dünnen Schichten über München", "Évolution des réseaux à débit garanti", "La gestión de índices según la región"] * 3
    planted = {f"g{i}": encoding.garble(t, c) for i, (t, c) in enumerate(zip(clean, ["utf-8>cp1252", "utf-8>cp850", "cp1252>mac_roman", "utf-8>cp1251", "utf-8>latin-1>utf-8>cp1252", "cp1252>cp437"]))}
    rows = [(f"c{i}", t) for i, t in enumerate(clean * 4)] + list(planted.items())
    df = spark.createDataFrame(rows, "urn string, title string")
    got = {r.urn: r.restored for r in encoding.restore(df, "urn", ["title"]).collect()}
    assert set(got) == set(planted)
    assert got == {k: clean[int(k[1:])] for k in planted}


def test_reading_distance():
    assert scanned.reading_distance("rnodern", "modern") == scanned.CHEAP
    assert abs(scanned.reading_distance("carefu1", "careful") - scanned.CHEAP) < 1e-9
    assert scanned.reading_distance("effuct", "effect") == 1
    assert scanned.deletions("rnodern") & scanned.deletions("modern")


def test_repair_joins_lines_and_words():
    text = "1 Introduction\nThe sof- \ntware was low-\nlatency.\nPage 12\nIt is c1ear that\nall is well.\nTable 1. Data, 2001"
    repaired = scanned.repair(text, {}, {"software"})
    assert "software was low-latency." in repaired and "Page 12" not in repaired
    assert repaired.split("\n")[0] == "1 Introduction" and "c1ear that all is well." in repaired


def test_weakly_joined_groups_are_divided(spark):
    a, b = list(range(1, 9)), list(range(11, 19))
    edges = [(x, y, 0.8) for g in (a, b) for x in g for y in g if x < y] + [(1, 11, 0.08)]
    got = {r.node: r.cluster for r in clusters.divide(spark.createDataFrame(edges, "a long, b long, affinity double"), spread=0.1).collect()}
    assert len({got[x] for x in a}) == 1 and len({got[x] for x in b}) == 1 and got[1] != got[11]


def test_division_in_one_task_is_the_division_by_joins(spark, monkeypatch):
    rng = np.random.default_rng(4)
    edges = []
    for c in range(30):
        sizes = rng.integers(2, 9, 1 + c % 4)
        parts = np.split(c * 100 + np.arange(sizes.sum()), np.cumsum(sizes)[:-1])
        edges += [(int(x), int(y), float(rng.uniform(0.3, 1.0))) for g in parts for x in g for y in g if x < y]
        edges += [(int(g[0]), int(h[0]), 0.05) for g, h in zip(parts, parts[1:])]
    df = spark.createDataFrame(edges, "a long, b long, affinity double")
    found = {}
    for inside in (0, 10**6):
        found[inside] = sorted(map(tuple, clusters.divide(df, inside=inside).collect()))
    assert found[0] == found[10**6] and len({c for _, c in found[0]}) > 40
    # components that fit one task need no plans of their own: none of the rounds of joins is started
    monkeypatch.setattr(clusters, "divide_spread", None)
    assert sorted(map(tuple, clusters.divide(df).collect())) == found[0]


def test_many_near_copies_stay_together(spark):
    rng = np.random.default_rng(3)
    words = [f"{a}o{b}o{c}o" for a in "bdkmprs" for b in "bdkmprsw" for c in "bdkmprsw"]
    base = [" ".join(rng.choice(words, 12)) + "." for _ in range(8)]
    rows = []
    for i in range(150):
        own = list(base)
        own[i % 8] = " ".join(rng.choice(words, 12)) + "."
        rows.append((f"u{i:03}", " ".join(own)))
    rows += [(f"v{i:03}", " ".join(" ".join(rng.choice(words, 12)) + "." for _ in range(8))) for i in range(50)]
    made = clusters.Clustering(spark.createDataFrame(rows, "urn string, abstract string"), "urn", "abstract")
    sizes = made.clusters().groupBy("cluster").count().collect()
    assert [r["count"] for r in sizes] == [150]


def _sentences(rng, n):
    words = [f"{a}o{b}o{c}o" for a in "bdkmprs" for b in "bdkmprsw" for c in "bdkmprsw"]
    return [" ".join(rng.choice(words, 12)) + "." for _ in range(n)]


def test_division_decides_over_the_components(spark):
    rng = np.random.default_rng(8)
    rows, families = [], []
    for f in range(2):
        base = _sentences(rng, 8)
        families.append(base)
        for i in range(6):
            own = list(base)
            own[i] = _sentences(rng, 1)[0]
            rows.append((f"f{f}v{i}", " ".join(own)))
    # a survey that takes some sentences of either family bridges them
    rows.append(("bridge", " ".join(families[0][5:] + families[1][5:] + _sentences(rng, 4))))
    made = clusters.Clustering(spark.createDataFrame(rows, "urn string, abstract string"), "urn", "abstract")
    assert clusters.connected_components(made.edges).select("component").distinct().count() == 1
    got = {r.key: r.cluster for r in made.clusters().collect()}
    assert len({got[f"f0v{i}"] for i in range(6)}) == len({got[f"f1v{i}"] for i in range(6)}) == 1
    assert got["f0v0"] != got["f1v0"]


def test_affinities_do_not_depend_on_batches(spark):
    rng = np.random.default_rng(9)
    notice, base = _sentences(rng, 1), _sentences(rng, 8)
    rows = [(i, " ".join(notice + (base[: 7 - i % 3] + _sentences(rng, 1 + i % 3) if i % 2 else _sentences(rng, 6)))) for i in range(240)]
    texts = spark.createDataFrame(rows, "node bigint, text string")
    found = []
    for rows_a_batch, parts in ((10_000, 1), (37, 5)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
        try:
            found.append(sorted(map(tuple, clusters.affinities(texts.repartition(parts), few=4).collect())))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] and len(found[0]) > 100


def test_all_pairs_of_frequent_shingles_count(spark, monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(12)
    pool = _sentences(rng, 14)
    texts = [" ".join(list(rng.choice(pool, rng.integers(1, 7), replace=False)) + _sentences(rng, int(rng.integers(0, 5)))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    made = next(iter(clusters._shingle(6, 3)(iter([pa.record_batch({"node": list(range(60)), "text": texts})])))).to_pylist()
    own, held = [dict(zip(r["shingles"], r["sentences"])) for r in made], [r["held"] for r in made]
    texts_of = Counter(s for o in own for s in o)
    monkeypatch.setattr(clusters, "BLOCK", 5)
    # all shingles tell of a sentence; those of more than a tenth of the texts do not
    for common in (1.0, 0.1):
        wanted = {}
        for a in range(60):
            for b in range(a + 1, 60):
                both = own[a].keys() & own[b].keys()
                usual = [s for s in both if texts_of[s] <= max(4, common * 60)]
                least, sentences = min(abs(held[a]), abs(held[b])), len({own[a][s] for s in usual})
                share, share_of_all = len(usual) / least, len(both) / least
                if share >= {1: 0.5 if min(held[a], held[b]) < 0 else 2, 2: 0.21, 3: 0.13}.get(sentences, 0.08 if sentences else 2) or share_of_all >= 0.6:
                    wanted[a, b] = round(min(1.0, share_of_all), 9)
        found = {(r.a, r.b): round(r.affinity, 9) for r in clusters.affinities(df, few=4, common=common).collect()}
        assert found == wanted and len(wanted) > 60


def test_winnowing_marks_common_runs():
    rng = np.random.default_rng(1)
    run = rng.integers(0, 2**60, 3, dtype=np.uint64)
    for _ in range(50):
        marks = []
        for _ in range(2):
            value = np.concatenate([rng.integers(0, 2**60, 5, dtype=np.uint64), run, rng.integers(0, 2**60, 4, dtype=np.uint64)])
            marks.append(set(value[clusters.winnow(value, np.zeros(len(value)), 3)].tolist()))
        assert marks[0] & marks[1] & set(run.tolist())


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abcd", max_size=7), st.text(alphabet="abcd", max_size=7))
def test_common_ratio(a, b):
    def lcs(i, j):
        return 0 if i == len(a) or j == len(b) else 1 + lcs(i + 1, j + 1) if a[i] == b[j] else max(lcs(i + 1, j), lcs(i, j + 1))

    assert names.common_ratio(a, b) == (2 * lcs(0, 0) / (len(a) + len(b)) if a or b else 1.0)


def test_label_model_finds_the_better_functions():
    rng = np.random.default_rng(5)
    right = [0.95, 0.9, 0.9, 0.95, 0.9, 0.9, 0.6]
    patterns, truth = Counter(), {}
    for _ in range(5000):
        y = rng.random() < 0.3
        code = 0
        for p in right:
            vote = (1 if y else -1) if rng.random() < p else (-1 if y else 1)
            code = code * 3 + vote + 1
        patterns[code] += 1
        truth.setdefault(code, []).append(y)
    posterior = linkage.fit_label_model(dict(patterns))
    assert np.mean([(posterior[c] > 0.5) == y for c, ys in truth.items() for y in ys]) > 0.97
    assert linkage.fit_label_model({}) == {}


def test_candidates_are_all_pairs_that_hold(spark):
    rng = np.random.default_rng(11)
    words = ["graph", "model", "network", "search", "index", "query", "store", "rank", "of", "on"]
    surnames = ["farkas", "novak", "lindgren", "horvath", "okafor"]
    papers = [("p" if i % 3 else "q", f"u{i}", " ".join(rng.choice(words, rng.integers(1, 7))), list(rng.choice(surnames, rng.integers(0, 3))) or None, None) for i in range(120)]
    described = spark.createDataFrame(papers, "peer string, urn string, title string, surnames array<string>, resource_url string")
    rows = [("p" if i % 2 else "q", i, f"{' and '.join(rng.choice(surnames, 2))} (1999). {' '.join(rng.choice(words, rng.integers(1, 8)))}. In Proc." if i else "", None) for i in range(150)]
    references = spark.createDataFrame(rows, "peer string, ref bigint, raw string, title string")
    found = {(r.ref, r.urn) for r in linkage.candidates(references, *linkage.index_papers(described)).collect()}
    wanted = {(ref, urn) for peer, ref, raw, title in rows for own, urn, held, names_, _ in papers if own == peer and linkage.held(raw if raw else title, held, names_ or [])}
    assert wanted and wanted <= found and len(found) < 3 * len(wanted)


def test_no_key_is_dropped_however_many_papers_share_it(spark):
    titles = ["ranking models of networks"] * 300
    described = spark.createDataFrame([("p", f"u{i}", t, ["farkas"], None) for i, t in enumerate(titles)], "peer string, urn string, title string, surnames array<string>, resource_url string")
    references = spark.createDataFrame([("p", 1, f"Novak, B., Lindgren, C., Horvath, D. and Farkas, A. (1999). {titles[0]}. In Proc.", None)], "peer string, ref bigint, raw string, title string")
    assert linkage.candidates(references, *linkage.index_papers(described)).count() == 300


def test_known_links_are_found(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["p3_found"](spark, folder).select("citing_urn", "cited_urn").distinct()
    true = read_table(spark, folder, "citations").select("citing_urn", "cited_urn").distinct()
    assert found.join(true, ["citing_urn", "cited_urn"], "left_semi").count() >= 0.98 * true.count()


def test_common_name_keys_are_refined_not_dropped(spark):
    surnames = ["sch" + a + b + "dtbauer" for a in "bdfgklmnpr" for b in "aeiouyw"]
    forms = spark.createDataFrame([(f"person|{s}|klara|", s, "klara", []) for s in surnames], "form string, surname string, given string, full array<string>")
    got = {(r.a, r.b) for r in names.candidate_pairs(forms).collect()}
    # a slip inside the surname: all keys that the two share hold all 70 forms
    assert ("person|schmidtbauer|klara|", "person|schmodtbauer|klara|") in got


def test_planted_spellings_are_linked(spark):
    given = ["robert", "maria", "anders", "claire", "yusuf", "helene", "tomas", "ingrid"]
    surnames = [f"{a}{b}{c}son" for a in ("brad", "kel", "vor", "lin") for b in ("ami", "oru", "ete") for c in ("k", "st", "nd")]
    people = [(g, s) for i, s in enumerate(surnames) for g in [given[i % len(given)]]]
    truth, rows = {}, []
    for n, (g, s) in enumerate(people):
        slip = s[:4] + s[5] + s[4] + s[6:]
        for name in (f"{g.title()} {s.title()}", f"{s.title()}, {g.title()}", f"{g[0].upper()}. {s.title()}", f"{g.title()} {slip.title()}", f"{g.title()} {s.title()}*"):
            truth[name] = n
            rows += [(name,)] * (3 if name.startswith(g.title()) else 1)
    got = {(r.name_a, r.name_b) for r in names.spelling_pairs(names.link_names(spark.createDataFrame(rows, "author_name string"))).collect()}
    wanted = {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}
    assert len(got & wanted) >= 0.95 * len(wanted) and len(got & wanted) >= 0.98 * len(got)


def test_planted_scanning_damage_is_found(spark):
    rng = np.random.default_rng(2)
    words = "modern carbon signal garden common furnace channel burning formal summer market system climate charming member problem".split()
    clean = {f"c{i}": " ".join(rng.choice(words, 60)) + "." for i in range(60)}
    misread = {f"m{i}": (t := " ".join(rng.choice(words, 60))).replace("modern", "rnodern", 1).replace("summer", "surnmer", 1) + " c1imate" for i in range(4)}
    broken = {f"b{i}": " ".join(rng.choice(words, 30)) + " prob-\nlem " + " ".join(rng.choice(words, 30)) for i in range(8)}
    headed = {f"h{i}": " ".join(rng.choice(words, 30)) + f"\nPage {i + 3}\n" + " ".join(rng.choice(words, 30)) for i in range(8)}
    df = spark.createDataFrame(list({**clean, **misread, **broken, **headed}.items()), "urn string, body string")
    scan = scanned.Scan(df, "urn", ["body"])
    assert {r.key for r in scan.damage().collect()} == {*misread, *broken, *headed}
    repaired = {r.key: r.repaired for r in scan.repaired().collect()}
    assert all("prob-" not in repaired[k] and " problem " in repaired[k] for k in broken) and all("Page" not in repaired[k] for k in headed) and all("c1imate" not in repaired[k] and "rnodern" not in repaired[k] for k in misread)


def test_no_result_depends_on_the_list_of_frequent_words(spark):
    papers = read_table(spark, DATA, "papers")
    found = [sorted(map(tuple, scanned.Scan(papers, "urn", ["abstract", "body"], known_words=n).damage().collect())) for n in (0, 50, 30_000)]
    assert found[0] == found[1] == found[2]


def test_short_forms_are_learned_from_the_collection(spark):
    rows = [("person", f"{a}{b}ner", g) for i, (a, b) in enumerate([(a, b) for a in "bdfgklmnpr" for b in "aeiouyw"]) for g in ((("robert", "bob") if i % 2 else ("maria", "mitzi")) if i < 20 else (("robert",), ("maria",), ("anna", "ivan"))[i % 3])]
    got = {(r.given, r.full) for r in names.short_forms(spark.createDataFrame(rows, "kind string, surname string, given string"), lift=2.0).collect()}
    assert {("bob", "robert"), ("mitzi", "maria")} <= got and all(x in {"bob", "mitzi", "anna"} for x, _ in got)


def test_subject_threshold_follows_one_rule_at_every_size(spark):
    lesser = [(i, "a", 0.02 + 0.001 * (i % 90), False) for i in range(300)] + [(300 + i, "b", 0.3 + 0.001 * (i % 150), False) for i in range(200)]
    composed = spark.createDataFrame(lesser, "doc_id bigint, subject string, share double, foremost boolean")
    copies = composed.crossJoin(spark.range(30).withColumnRenamed("id", "copy")).drop("copy")
    labels = [(i, ["b"] if i >= 300 and i % 3 else ["c"]) for i in range(0, 500, 2)]
    sample = spark.createDataFrame(labels, "doc_id bigint, own array<string>")
    found = subjects.threshold(composed, sample)
    assert 0.11 <= found <= 0.3 and found == subjects.threshold(copies, sample)
    assert 0.11 <= subjects.threshold(composed, sample.limit(0)) <= 0.5


def test_every_labelled_document_counts_for_the_subjects(spark):
    rng = np.random.default_rng(6)
    words = {"art": "paint canvas gallery brush museum sculptor".split(), "sea": "harbour sailor tide vessel anchor reef".split()}
    rows = [(i, s, " ".join(rng.choice(words[s], 8)) + ". " + " ".join(rng.choice(words[s], 7)) + ".") for i in range(300) for s in [("art", "sea")[i % 2]]]
    # a word that only two documents hold, of whichever shards these are
    rows += [(900, "art", "zebu zebu zebu zebu zebu."), (901, "art", "zebu zebu zebu zebu zebu.")]
    documents = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, s) for i, s, _ in rows], "doc_id bigint, subject string")
    names_ = spark.createDataFrame([("art",), ("sea",)], "subject string")
    sample = subjects.sampled(labels)
    assert sample.count() == 302
    for shard in (20_000, 20):
        model = subjects.train(documents, sample, names_, shard)
        features, begins, _ = subjects.sentence_features(["zebu zebu zebu zebu"], {})
        z = subjects.scores(model.weights, features, begins)
        assert z[0, 0] > z[0, 1]
        found = {(r.doc_id, r.subject) for r in subjects.compositions(documents, model).where("foremost").collect()}
        assert found == {(i, s) for i, s, _ in rows}
    many = spark.range(20_500).select(F.col("id").alias("doc_id"), F.lit("art").alias("subject"))
    assert subjects.sampled(many).count() == 20_500


def test_subjects_of_held_out_labels_are_found(spark):
    folder = "/root/testdata/sf0.1"
    documents, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "subject_labels")
    seen = subjects.sampled(labels.where("doc_id % 5 <> 0"))
    model = subjects.train(documents, seen, read_table(spark, folder, "subjects"))
    held_out = labels.where("doc_id % 5 = 0 and subject is not null").select("doc_id", "subject").distinct()
    found = subjects.classify(documents.join(held_out, "doc_id", "left_semi"), model, seen)
    # some labels are wrong
    assert held_out.join(found, ["doc_id", "subject"], "left_semi").count() >= 0.9 * held_out.count()
