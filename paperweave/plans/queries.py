"""The queries over the test tables. Their SQL is in ``paperweave.plans.oracles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperweave.functions import porter
from paperweave.functions import text as T
from paperweave.operators import corpus, evaluate, extract, graph, index, linking, lsi, present, profiles, search, social
from paperweave.operators.components import connected_components
from paperweave.plans.oracles import BUDDY_PEER, QUERY, SQL  # noqa: F401
from paperweave.plans.runtime import cut_lineage, read_table, shared_folder
from paperweave.sources import files
from paperweave.streaming import peers

REPEATED = "network network model"
NEEDLE_AUTHOR = "guadalupe"


def _index(spark: SparkSession, d: str, zones: tuple[str, ...] = corpus.ZONES) -> index.Index:
    return index.build_index(read_table(spark, d, "papers"), zones)


_written: dict[tuple[str, str, tuple[str, ...]], str] = {}


def _stored(spark: SparkSession, d: str, zones: tuple[str, ...] = corpus.ZONES) -> index.Index:
    """The index of a folder of tables, or of some zones of it, written once an application and read by every query after."""
    whole, key = ((spark.sparkContext.applicationId, d, z) for z in (corpus.ZONES, zones))
    if whole in _written:
        key = whole
    if key not in _written:
        folder = shared_folder(spark, f"index-{len(_written)}")
        index.write_index(_index(spark, d, zones), folder)
        _written[key] = folder
    return index.read_index(spark, _written[key])


def _linked(spark: SparkSession, d: str) -> index.Index:
    """What the linker reads: the texts' bodies, most of the index, are not in it."""
    zones = ("title", "abstract")
    return _stored(spark, d, zones).narrowed(zones)


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    # adding 0 turns a negative zero into zero
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})


def tokenize_zone(spark, d):
    terms = T.explode_terms(corpus.zones_of(corpus.known_papers(read_table(spark, d, "papers"))), "text")
    return terms.groupBy("peer", "zone", "urn").agg(F.count("*").alias("n_terms"), F.min("term").alias("first_term"), F.max("term").alias("last_term"))


def stopword_filter(spark, d):
    kept = lambda stops: T.explode_terms(corpus.zones_of(corpus.known_papers(read_table(spark, d, "papers"))), "text", stops=stops).groupBy("peer", "zone").agg(F.count("*").alias("n"))
    return kept(("",)).withColumnRenamed("n", "before").join(kept(None).withColumnRenamed("n", "after"), ["peer", "zone"])


def term_frequency(spark, d):
    return _index(spark, d).frequencies


def document_frequency_idf(spark, d):
    return _rounded(_index(spark, d).idf, "idf")


def tfidf_postings(spark, d):
    return _rounded(_index(spark, d).postings, "weight")


def doc_norms(spark, d):
    norms = _index(spark, d).postings.groupBy("peer", "zone", "urn").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return _rounded(norms, "norm")


def index_stats(spark, d):
    return index.index_stats(_index(spark, d).frequencies)


def term_doc_matrix_export(spark, d):
    rows = index.matrix_rows(_stored(spark, d).narrowed(("title",)).postings, "%.3f")
    return rows.select("peer", "term", F.size(F.split("line", ",")).alias("cells"), F.aggregate(F.split("line", ","), F.lit(0), lambda s, x: s + (x != "0.000").cast("int")).alias("filled"))


def vocabulary_export(spark, d):
    return index.vectors(_stored(spark, d).narrowed(("title",)).postings).select("peer", "papers", "terms")


def _search(spark, d, zones, query=QUERY, k=10, mode="or"):
    made = _stored(spark, d).narrowed(tuple(zones), search.typed_terms({"q": query}))
    return _rounded(search.search(made, search.make_queries(spark, {"q": query}), zones, k, mode), "score").select("peer", "result_rank", "urn", "score")


def search_title(spark, d):
    return _search(spark, d, {"title": 1.0})


def search_abstract(spark, d):
    return _search(spark, d, {"abstract": 1.0})


def search_all(spark, d):
    return _search(spark, d, search.TITLE_AND_ABSTRACT)


def search_fulltext(spark, d):
    return _search(spark, d, search.FULL_TEXT)


def search_fulltext_declared(spark, d):
    return _search(spark, d, search.FULL_TEXT_DECLARED)


def search_duplicate_terms(spark, d):
    return _search(spark, d, {"abstract": 1.0}, REPEATED)


def search_and_mode(spark, d):
    return _search(spark, d, {"abstract": 1.0}, mode="and")


def search_batch(spark, d):
    typed = {"a": QUERY, "b": REPEATED, "c": "unknownterm"}
    made = _stored(spark, d).narrowed(("title", "abstract"), search.typed_terms(typed))
    found = search.search(made, search.make_queries(spark, typed), search.TITLE_AND_ABSTRACT, 5)
    return _rounded(found, "score").select("query_id", "peer", "result_rank", "urn", "score")


def _papers(spark, d):
    return corpus.known_papers(read_table(spark, d, "papers"))


def author_search(spark, d):
    return search.search_authors(read_table(spark, d, "paper_authors"), _papers(spark, d), f"{NEEDLE_AUTHOR} x").select("peer", "urn")


def citation_counts(spark, d):
    return search.citation_counts(_papers(spark, d), read_table(spark, d, "citations"))


def cited_by(spark, d):
    """Papers that cite the most cited one of each peer."""
    edges = graph.edges_of(read_table(spark, d, "citations"), _papers(spark, d))
    counts = edges.groupBy("peer", "cited_urn").agg(F.count("*").alias("n"))
    top = counts.withColumn("place", F.row_number().over(Window.partitionBy("peer").orderBy(F.desc("n"), "cited_urn"))).where("place = 1").select("peer", "cited_urn")
    return edges.join(top, ["peer", "cited_urn"], "left_semi").select("peer", "cited_urn", "citing_urn")


def search_enriched(spark, d):
    papers, citations = _papers(spark, d), read_table(spark, d, "citations")
    found = _search(spark, d, {"title": 1.0}, k=3)
    return search.enrich(found, papers, citing=search.citation_counts(papers, citations)).select("peer", "result_rank", "urn", "title", "cited_by")


def link_citations(spark, d):
    made = _linked(spark, d)
    return _rounded(linking.link_citations(made, read_table(spark, d, "bib_refs")), "overlap")


def link_citations_gated(spark, d):
    """The older variant: coefficients 0.95 and 0.05 and a least score."""
    made = _linked(spark, d)
    return linking.citation_edges(linking.link_citations(made, read_table(spark, d, "bib_refs"), alpha=0.95, least_score=0.20))


def link_citations_oldest(spark, d):
    """The oldest variant: the best three by title and abstract, from a score of 0.40 on."""
    made = _linked(spark, d)
    return linking.citation_edges(linking.link_citations(made, read_table(spark, d, "bib_refs"), k=3, least_score=0.40))


def link_citations_incremental(spark, d):
    made = _linked(spark, d)
    return linking.citation_edges(linking.link_citations(made, read_table(spark, d, "bib_refs"), unresolved_only=True))


def link_evaluation(spark, d):
    """Measures of the linker against the known links, over the papers that have any."""
    made = _linked(spark, d)
    true = read_table(spark, d, "citations").select("peer", "citing_urn", "cited_urn")
    found = linking.citation_edges(linking.link_citations(made, read_table(spark, d, "bib_refs"))).join(true.select("citing_urn").distinct(), "citing_urn", "left_semi")
    counts = evaluate.confusion(found, true, ["peer", "citing_urn", "cited_urn"])
    m = evaluate.measures(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return _rounded(counts.select("tp", "fp", "fn", m["precision"].alias("precision"), m["recall"].alias("recall"), m["f"].alias("f1")), "precision", "recall", "f1")


def reference_overlap(spark, d):
    """Tokens of printed titles as the linker sees them."""
    refs = read_table(spark, d, "bib_refs").where("title is not null").dropDuplicates(["citing_urn", "ref_pos"])
    return refs.select("citing_urn", "ref_pos", F.array_join(T.reference_tokens(F.col("title")), " ").alias("tokens"))


def _edges(spark, d):
    return graph.edges_of(read_table(spark, d, "citations"), _papers(spark, d))


def build_and_analyse(spark, d):
    """The citation graph as the linker builds it from the reference strings, and the rank of every paper in it."""
    made = _linked(spark, d)
    links = linking.link_citations(made, read_table(spark, d, "bib_refs"))
    edges = cut_lineage(graph.edges_of(linking.citation_edges(links), made.papers))
    return _rounded(graph.pagerank(made.papers, edges), "rank")


def graph_counters(spark, d):
    made, refs = _linked(spark, d), read_table(spark, d, "bib_refs")
    return graph.graph_counters(refs, linking.link_citations(made, refs, unresolved_only=True))


def adjacency_dump(spark, d):
    return graph.adjacency_lines(_papers(spark, d), _edges(spark, d))


def pagerank(spark, d):
    return _rounded(graph.pagerank(_papers(spark, d), _edges(spark, d)), "rank")


def pagerank_color_scale(spark, d):
    return graph.color_scale(graph.pagerank(_papers(spark, d), _edges(spark, d))).select("peer", "urn", "color")


def pagerank_lineitem(spark, d):
    """The same walk on a larger graph: parts returned together in an order."""
    items = read_table(spark, d, "lineitem").where("l_returnflag = 'R'")
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    edges = items.select(F.col("l_partkey").alias("a"), after.alias("b")).where("a > b").distinct()
    edges = edges.select(F.lit("all").alias("peer"), F.col("a").alias("citing_urn"), F.col("b").alias("cited_urn"))
    nodes = read_table(spark, d, "part").select(F.lit("all").alias("peer"), F.col("p_partkey").alias("urn"))
    return _rounded(graph.pagerank(nodes, edges), "rank", places=9).select("urn", "rank")


def dangling_nodes(spark, d):
    return graph.dangling_nodes(_papers(spark, d), _edges(spark, d))


def citation_dot(spark, d):
    return graph.dot_lines(graph.pagerank(_papers(spark, d), _edges(spark, d)), _edges(spark, d), _papers(spark, d))


def citation_components(spark, d):
    edges = _edges(spark, d)
    return connected_components(edges, "citing_urn", "cited_urn").select(F.col("node").alias("urn"), "component")


def _centroid(spark, d):
    return cut_lineage(profiles.centroid(_stored(spark, d).narrowed(("abstract",)).postings))


def peer_centroid(spark, d):
    return _rounded(profiles.centroid(_stored(spark, d).narrowed(("abstract",)).postings), "weight")


def peer_rss(spark, d):
    return _rounded(profiles.rss(_stored(spark, d).narrowed(("abstract",)).postings), "rss")


def centroid_top50(spark, d):
    return _rounded(profiles.top_terms(_centroid(spark, d)), "weight")


def centroid_ratio(spark, d):
    whole = _centroid(spark, d)
    return _rounded(profiles.length_ratio(profiles.top_terms(whole), whole), "ratio")


def centroid_stemmed30(spark, d):
    return _rounded(profiles.stemmed_profile(_centroid(spark, d)), "weight")


def peer_similarity(spark, d):
    return _rounded(social.similarities(cut_lineage(profiles.top_terms(_centroid(spark, d)))), "sim")


def _buddies(spark, d):
    top = cut_lineage(profiles.top_terms(_centroid(spark, d)))
    return top, cut_lineage(social.buddies(social.similarities(top)))


def taste_buddies(spark, d):
    return _rounded(_buddies(spark, d)[1], "sim")


def taste_buddies_stemmed(spark, d):
    """The neighbours as peers compute them, from stemmed profiles."""
    profile = cut_lineage(profiles.stemmed_profile(_centroid(spark, d)))
    return _rounded(social.buddies(social.similarities(profile)), "sim")


def friendship_stats(spark, d):
    return social.friendship_stats(_papers(spark, d).select("peer").distinct(), _buddies(spark, d)[1])


def recommendations(spark, d):
    top, chosen = _buddies(spark, d)
    return _rounded(social.recommendations(_stored(spark, d).narrowed(("title",)), chosen, top), "score")


def p2p_search(spark, d):
    _, chosen = _buddies(spark, d)
    made = _stored(spark, d).narrowed(corpus.ZONES, search.typed_terms({"q": QUERY}))
    return _rounded(social.federated_search(made, search.make_queries(spark, {"q": QUERY}), BUDDY_PEER, chosen), "score").select("origin", "result_rank", "urn", "score")


def gossip_neighbours(spark, d):
    similar = cut_lineage(social.similarities(cut_lineage(profiles.top_terms(_centroid(spark, d)))))
    names = _papers(spark, d).select("peer").distinct()
    ring = names.select("peer", F.lead("peer").over(Window.orderBy("peer")).alias("buddy")).where("buddy is not null")
    return _rounded(social.gossip_neighbours(similar, ring), "sim")


def tag_cloud(spark, d):
    return present.tag_cloud(profiles.top_terms(_centroid(spark, d), 30)).select("peer", "term", "font")


def paper_classifier(spark, d):
    docs = read_table(spark, d, "documents")
    return docs.select("doc_id", extract.paper_score(F.col("text")).alias("score"), extract.is_paper(F.col("text")).alias("paper"))


def reference_split(spark, d):
    """Bibliographies put together from the printed references of each paper and cut again."""
    refs = read_table(spark, d, "bib_refs").dropDuplicates(["citing_urn", "ref_pos"]).where("raw is not null")
    text = refs.groupBy("citing_urn").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ref_pos", "raw"))), lambda x: x["raw"]), " ").alias("bibliography"))
    return text.select("citing_urn", F.posexplode(extract.split_references_udf("bibliography")).alias("pos", "raw"))


def reference_labels(spark, d):
    refs = read_table(spark, d, "bib_refs").dropDuplicates(["citing_urn", "ref_pos"])
    return refs.select("citing_urn", "ref_pos", extract.label_reference(F.col("raw")).alias("f")).select("citing_urn", "ref_pos", "f.title", "f.booktitle", "f.pages", "f.date")


def author_filter(spark, d):
    lines = read_table(spark, d, "paper_authors").dropDuplicates(["urn", "author_pos"]).groupBy("urn").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("author_pos", "author_name"))), lambda x: x["author_name"]), ", ").alias("line"))
    return lines.select("urn", F.explode(extract.author_names_udf("line")).alias("author_name"))


def layout_parse(spark, d):
    """Papers written as converted pages, and parsed again."""
    p = _papers(spark, d).where("abstract <> '' and body is not null")
    style = "<!-- .ft0{font-size:24px;} .ft1{font-size:16px;} .ft2{font-size:12px;} --><!-- Page 1 -->"
    line = lambda top, font, c: F.concat(F.lit(f'<div style="position:absolute;top:{top};left:90"><span class="ft{font}">'), c, F.lit("</span></div>"))
    html = F.concat(F.lit(style), line(100, 0, F.col("title")), line(300, 1, F.concat(F.lit("Abstract "), F.col("abstract"))), line(500, 2, F.concat(F.lit("Introduction "), F.col("body"))), line(900, 2, F.lit("References")))
    return extract.parse_documents(p.select(F.col("urn").alias("doc_id"), html.alias("html"))).select("doc_id", "title", F.length("abstract").alias("abstract_chars"), F.length("body").alias("body_chars"))


def result_xml(spark, d):
    papers = _papers(spark, d)
    names = read_table(spark, d, "paper_authors").dropDuplicates(["urn", "author_pos"]).groupBy("peer", "urn").agg(F.transform(F.sort_array(F.collect_list(F.struct("author_pos", "author_name"))), lambda x: x["author_name"]).alias("authors"))
    found = _search(spark, d, search.TITLE_AND_ABSTRACT, k=3).join(papers, ["peer", "urn"]).join(names, ["peer", "urn"], "left")
    full = found.withColumns({"query_id": F.lit("q"), "pagerank": F.lit(-1.0), "cited_by": F.lit(0).cast("bigint")})
    return present.read_results(present.result_xml(full))


def edit_distance(spark, d):
    """Printed titles against the titles of the papers that earlier links name."""
    refs = read_table(spark, d, "bib_refs").where("title is not null and cited_urn is not null").dropDuplicates(["citing_urn", "ref_pos"])
    pairs = refs.join(_papers(spark, d).select(F.col("urn").alias("cited_urn"), F.col("title").alias("t")), "cited_urn")
    return pairs.select("citing_urn", "ref_pos", T.edit_distance(F.col("title"), F.col("t")).alias("distance"))


def hamming_distance(spark, d):
    a = read_table(spark, d, "nation").select(F.col("n_name").alias("a"))
    return a.join(a.withColumnRenamed("a", "b"), F.length("a") == F.length("b")).select("a", "b", T.hamming_distance(F.col("a"), F.col("b")).alias("distance"))


def edit_distance_links(spark, d):
    return linking.link_by_edit_distance(_papers(spark, d), read_table(spark, d, "bib_refs"))


def clean_titles(spark, d):
    p = read_table(spark, d, "papers").dropDuplicates(["urn"]).where("title is not null")
    return p.select("urn", T.single_spaced(T.expand_ligatures(F.col("title"))).alias("title"))


def stem_terms(spark, d):
    terms = _stored(spark, d).idf.select("term").distinct()
    return terms.select("term", porter.porter_stem("term").alias("stem"))


def known_resources(spark, d):
    p = read_table(spark, d, "papers").select(files.resource_key(F.col("resource_url")).alias("resource_key"), F.col("resource_url").startswith("file:").alias("is_file"), "peer")
    return files.absent(p.where("resource_key is not null"), p.where("peer = 'mirelo'").select("resource_key").distinct(), "resource_key").select("resource_key")


def _events(spark, d):
    return read_table(spark, d, "peer_events")


def peer_presence(spark, d):
    return peers.presence(_events(spark, d), "2 hours").select("peer", F.date_format("seen_from", "yyyy-MM-dd HH:mm:ss").alias("seen_from"), F.date_format("seen_to", "yyyy-MM-dd HH:mm:ss").alias("seen_to"))


def peer_liveness(spark, d):
    return peers.live_at(_events(spark, d), "2009-01-20 00:00:00", "1 day").select("peer", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), "live")


def peer_ports(spark, d):
    return peers.ports(peers.registered(_events(spark, d)))


def latest_profile(spark, d):
    """Profiles posted with every heartbeat: the newest counts, whenever it arrived."""
    posts = _events(spark, d).where("peer is not null").groupBy("peer", "ts").agg(F.min("kind").alias("profile"))
    return peers.latest_profiles(posts).select("peer", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "profile")


def stream_presence(spark, d):
    """The same stretches from a stream of the table's files, run to its end; late events are kept by a long delay."""
    import uuid

    source = _events(spark, d)
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/peer_events.parquet") if _is_folder(spark, f"{d}/peer_events.parquet") else spark.readStream.schema(source.schema).option("pathGlobFilter", "peer_events.parquet").parquet(d)
    name = f"presence_{uuid.uuid4().hex}"
    spans = peers.presence(stream.where("peer is not null"), "2 hours", late="365 days")
    spans.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).groupBy("peer").agg(F.count("*").alias("stretches"), F.sum("events").alias("events"))


def _is_folder(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def embedding_neighbors(spark, d):
    vectors = read_table(spark, d, "embeddings")
    return _rounded(lsi.nearest_vectors(vectors.where("vec_id % 20 = 0"), vectors), "sim").select("vec_id", "neighbour", "sim", "place")


def kmeans_docs(spark, d):
    return lsi.group_vectors(read_table(spark, d, "embeddings"))


def lsi_singular_values(spark, d):
    values, _ = lsi.singular_vectors(_stored(spark, d).narrowed(("title",)).postings, 5)
    return _rounded(spark.createDataFrame(list(enumerate(values)), "place int, value double"), "value", places=4)


def lsi_documents(spark, d):
    """Titles in the space of the five leading singular vectors; the sign of a vector is free, so absolute values."""
    postings = _stored(spark, d).narrowed(("title",)).postings
    values, terms = lsi.singular_vectors(postings, 5)
    return lsi.documents_in_space(postings, terms, len(values)).select("peer", "urn", F.transform("coordinates", lambda x: F.round(F.abs(x), 4)).alias("coordinates"))


def document_cosines(spark, d):
    made = _stored(spark, d).narrowed(("abstract",))
    asked = made.papers.where(F.substring("urn", 4, 9).cast("int") % 20 == 0)
    return _rounded(lsi.document_similarities(made.postings, asked), "sim").where("sim >= 0.3")


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_zone, stopword_filter, term_frequency, document_frequency_idf, tfidf_postings, doc_norms, index_stats, term_doc_matrix_export, vocabulary_export,
        search_title, search_abstract, search_all, search_fulltext, search_fulltext_declared, search_duplicate_terms, search_and_mode, search_batch, author_search, citation_counts, cited_by, search_enriched,
        link_citations, link_citations_gated, link_citations_oldest, link_citations_incremental, link_evaluation, reference_overlap,
        build_and_analyse, graph_counters, adjacency_dump, pagerank, pagerank_color_scale, pagerank_lineitem, dangling_nodes, citation_dot, citation_components,
        peer_centroid, peer_rss, centroid_top50, centroid_ratio, centroid_stemmed30, peer_similarity, taste_buddies, taste_buddies_stemmed, friendship_stats, recommendations, p2p_search, gossip_neighbours, tag_cloud,
        paper_classifier, reference_split, reference_labels, author_filter, layout_parse, result_xml,
        edit_distance, hamming_distance, edit_distance_links, clean_titles, stem_terms, known_resources,
        peer_presence, peer_liveness, peer_ports, latest_profile, stream_presence, embedding_neighbors, kmeans_docs, lsi_singular_values, lsi_documents, document_cosines,
    )
}
