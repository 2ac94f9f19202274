"""The pN_ queries over the test tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.llm import clusters, distinctiveness, encoding, linkage, mixing, names, packing, scanned, subjects, term_counts
from paperweave.llm.tokens import count_tokens
from paperweave.plans.runtime import cut_lineage, read_table

TERM_RUN = "[A-Za-zÀ-ÖØ-öø-ÿ]+"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = clusters.Clustering(read_table(spark, sf_dir, "papers"), "urn", "abstract")
    return clusters.pairs(cut_lineage(made.clusters())).toDF("urn_a", "urn_b")


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and most typical papers of every cluster."""
    return clusters.Clustering(read_table(spark, sf_dir, "papers"), "urn", "abstract").described()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.find_garbled(read_table(spark, sf_dir, "papers"), "urn", ["title", "abstract"]).select("urn", "field")


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.restore(read_table(spark, sf_dir, "papers"), "urn", ["title", "abstract"])


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with its confidence."""
    return linkage.link(*(read_table(spark, sf_dir, t) for t in ("bib_refs", "papers", "paper_authors")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_links(spark, sf_dir).where("confidence >= 0.5").select("citing_urn", "ref_pos", "cited_urn")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = term_counts.mark_terms(read_table(spark, sf_dir, "papers"), "urn", ["abstract", "body"])
    return marked.where((F.col("n_terms") == 1) & F.col("mark").isNotNull()).select(F.col("ngram").alias("term"), "mark")


def p4_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts.mark_terms(read_table(spark, sf_dir, "papers"), "urn", ["abstract", "body"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = distinctiveness.score_terms(read_table(spark, sf_dir, "papers"), "urn", ["title", "abstract"])
    return scored.where("tf >= 3 and records between 2 and 8").select("urn", "term")


def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = distinctiveness.score_terms(read_table(spark, sf_dir, "papers"), "urn", ["title", "abstract"])
    return scored.withColumn("score", F.round("score", 6))


def p6_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with the person or group it means."""
    return names.link_names(read_table(spark, sf_dir, "paper_authors"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.spelling_pairs(cut_lineage(p6_entities(spark, sf_dir)))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.Scan(read_table(spark, sf_dir, "papers"), "urn", ["abstract", "body"]).damage().select(F.col("key").alias("urn"), "field")


def p7_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.Scan(read_table(spark, sf_dir, "papers"), "urn", ["abstract", "body"]).repaired().withColumnRenamed("key", "urn")


def _packs(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    """The packs of the small, fixed table pack_specs, one after the other over the same measured documents."""
    specs = read_table(spark, sf_dir, "pack_specs").where("pack_name is not null and capacity_tokens > 0")
    measured = packing.measure(read_table(spark, sf_dir, "documents"))
    made = None
    for spec in (specs.where(F.col("pack_name") == only) if only else specs).orderBy("pack_name").collect():
        own = packing.pack(measured, spec.capacity_tokens, spec.pack_name).withColumn("pack_name", F.lit(spec.pack_name))
        made = own if made is None else made.unionByName(own)
    if made is None:
        raise ValueError("pack_specs names no such pack")
    return made.withColumnRenamed("key", "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packs(spark, sf_dir, "std").where("part = 1").select("doc_id")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in every pack."""
    return _packs(spark, sf_dir).select("pack_name", "container", "doc_id", "part", "start_token", "n_tokens")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(count_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, targets = _sizes(spark, sf_dir), read_table(spark, sf_dir, "mix_targets")
    return mixing.report(mixing.assign(sizes, targets), mixing.demands(sizes, targets))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_report(spark, sf_dir).where("not full").select("source")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix in training order."""
    return mixing.assign(_sizes(spark, sf_dir), read_table(spark, sf_dir, "mix_targets")).orderBy("position", "source", "doc_id", "pass")


def p10_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's subjects with their shares."""
    documents = read_table(spark, sf_dir, "documents")
    sample = cut_lineage(subjects.sampled(read_table(spark, sf_dir, "subject_labels")))
    return subjects.classify(documents, subjects.train(documents, sample, read_table(spark, sf_dir, "subjects")), sample)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_subjects(spark, sf_dir).select("doc_id", "subject")


QUERIES = {"p1_found": p1_found, "p1_clusters": p1_clusters, "p2_found": p2_found, "p2_restored": p2_restored, "p3_found": p3_found, "p3_links": p3_links, "p4_found": p4_found, "p4_ngrams": p4_ngrams, "p5_found": p5_found, "p5_scores": p5_scores, "p6_found": p6_found, "p6_entities": p6_entities, "p7_found": p7_found, "p7_repaired": p7_repaired, "p8_found": p8_found, "p8_containers": p8_containers, "p9_found": p9_found, "p9_report": p9_report, "p9_mix": p9_mix, "p10_found": p10_found, "p10_subjects": p10_subjects}

_ONCE = "SELECT urn, any_value(title) AS title, any_value(abstract) AS abstract, any_value(body) AS body FROM papers WHERE urn IS NOT NULL GROUP BY urn"


def _terms(*fields: str) -> str:
    found = " || ".join(f"regexp_extract_all(coalesce({f}, ''), '{TERM_RUN}')" for f in fields)
    return f"list_transform(list_filter({found}, lambda x: length(x) >= 3), lambda x: lower(x))"


_HELD = "held AS (SELECT term, count(*) AS occurrences, count(DISTINCT urn) AS records FROM terms GROUP BY term)"

SQL = {
    "p4_found": f"""WITH once AS ({_ONCE}), terms AS (SELECT urn, unnest({_terms("abstract", "body")}) AS term FROM once), {_HELD},
        n AS (SELECT count(*) AS n FROM once)
        SELECT term, CASE WHEN records < 3 THEN 'rare' ELSE 'common' END AS mark FROM held, n WHERE records < 3 OR records * 3 > n""",
    "p4_ngrams": f"""WITH once AS ({_ONCE}), texts AS (SELECT urn, {_terms("abstract")} AS w FROM once UNION ALL SELECT urn, {_terms("body")} FROM once),
        terms AS (SELECT urn, unnest(w) AS term, 1 AS n_terms FROM texts UNION ALL
            SELECT urn, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM texts UNION ALL
            SELECT urn, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM texts),
        n AS (SELECT count(*) AS n FROM once)
        SELECT term AS ngram, CAST(n_terms AS INTEGER) AS n_terms, count(*) AS occurrences, count(DISTINCT urn) AS records,
            CASE WHEN count(DISTINCT urn) < 3 THEN 'rare' WHEN count(DISTINCT urn) * 3 > any_value(n) THEN 'common' END AS mark
        FROM terms, n GROUP BY term, n_terms""",
    "p5_found": f"""WITH once AS ({_ONCE}), terms AS (SELECT urn, unnest({_terms("title", "abstract")}) AS term FROM once), {_HELD}
        SELECT urn, term FROM terms JOIN held USING (term) WHERE records BETWEEN 2 AND 8 GROUP BY urn, term HAVING count(*) >= 3""",
    "p5_scores": f"""WITH once AS ({_ONCE}), texts AS (SELECT urn, {_terms("title")} AS w FROM once UNION ALL SELECT urn, {_terms("abstract")} FROM once),
        terms AS (SELECT urn, unnest(w) AS term FROM texts), {_HELD},
        ahead AS (SELECT urn, w, unnest(range(1, len(w) + 1)) AS i FROM texts),
        pairs AS (SELECT urn, w[i] AS a, w[i + 1] AS b FROM ahead UNION ALL SELECT urn, w[i], w[i + 2] FROM ahead UNION ALL SELECT urn, w[i], w[i + 3] FROM ahead),
        near AS (SELECT urn, a AS term, b FROM pairs WHERE b IS NOT NULL AND a <> b UNION SELECT urn, b, a FROM pairs WHERE b IS NOT NULL AND a <> b),
        degrees AS (SELECT urn, term, count(*) AS degree FROM near GROUP BY urn, term),
        tf AS (SELECT urn, term, count(*) AS tf FROM terms GROUP BY urn, term), n AS (SELECT count(*) AS n FROM once)
        SELECT urn, term, CAST(tf AS INTEGER) AS tf, CAST(coalesce(degree, 0) AS INTEGER) AS degree, records,
            round(coalesce(degree, 0) * ln(CAST(n AS DOUBLE) / records), 6) AS score
        FROM tf JOIN held USING (term) LEFT JOIN degrees USING (urn, term), n""",
}
