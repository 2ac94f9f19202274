"""The queries in ANSI SQL, for a comparison on the same tables."""

from __future__ import annotations

from paperweave.functions.text import SPACE, stop_words

QUERY = "index query model systematic network"
REPEATED = "network network model"
BUDDY_PEER = "mirelo"
BIG = "'.,:;''()\"'"

PAPERS = "papers1 AS (SELECT peer, urn, any_value(title) AS title, any_value(abstract) AS abstract, any_value(body) AS body, any_value(resource_url) AS resource_url FROM papers WHERE peer IS NOT NULL AND urn IS NOT NULL GROUP BY peer, urn HAVING coalesce(any_value(title), '') <> '')"
ZONES = "zones AS (SELECT peer, urn, 'title' AS zone, title AS txt FROM papers1 WHERE title <> '' UNION ALL SELECT peer, urn, 'abstract', abstract FROM papers1 WHERE abstract <> '' UNION ALL SELECT peer, urn, 'body', body FROM papers1 WHERE body <> '')"
STOPS = ", ".join(f"'{w}'" for w in stop_words())
TOKENS = f"tokens AS (SELECT peer, urn, zone, unnest(string_split_regex(lower(txt), '{SPACE}')) AS token FROM zones)"
CLEAN = f"""clean AS (SELECT peer, urn, zone, translate(regexp_replace(translate(token, {BIG}, ''), '^-|-$', '', 'g'), '?‘’', '') AS term FROM tokens WHERE regexp_matches(token, '[a-z]{{2,}}'))"""
TERMS = f"terms AS (SELECT * FROM clean WHERE term <> '' AND term NOT IN ({STOPS}))"
BASE = f"{PAPERS}, {ZONES}, {TOKENS}, {CLEAN}, {TERMS}"
POSTINGS = """
    counts AS (SELECT peer, count(*) AS n FROM papers1 GROUP BY peer),
    tf AS MATERIALIZED (SELECT peer, zone, urn, term, count(*) AS tf FROM terms GROUP BY ALL),
    idf AS MATERIALIZED (SELECT peer, zone, term, count(*) AS df, ln(CAST(any_value(n) AS DOUBLE) / count(*)) AS idf FROM tf JOIN counts USING (peer) GROUP BY peer, zone, term),
    raw AS (SELECT peer, zone, urn, term, tf, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY peer, zone, urn)) AS norm FROM tf JOIN idf USING (peer, zone, term)),
    postings AS MATERIALIZED (SELECT peer, zone, urn, term, tf, CASE WHEN norm > 0 THEN w / norm ELSE 0 END AS weight FROM raw)"""
INDEX = f"WITH {BASE}, {POSTINGS}"


def _search(zones: dict[str, float], query: str = QUERY, k: int = 10, every: bool = False, name: str = "") -> str:
    words = query.split()
    asked = " UNION ALL ".join(f"SELECT '{w}' AS term, {words.count(w)} AS m" for w in dict.fromkeys(words))
    weights = " ".join(f"WHEN '{z}' THEN {c}" for z, c in zones.items())
    inside = ", ".join(f"'{z}'" for z in zones)
    return f"""asked{name} AS ({asked}),
        wq{name} AS (SELECT peer, zone, term, m, m * idf AS wq, sqrt(sum(m * m * idf * m * idf) OVER (PARTITION BY peer, zone)) AS norm FROM idf JOIN asked{name} USING (term) WHERE zone IN ({inside})),
        scores{name} AS (SELECT peer, urn, sum((CASE zone {weights} END) * m * weight * CASE WHEN norm > 0 THEN wq / norm ELSE 0 END) AS score, count(DISTINCT term) AS found
            FROM postings JOIN wq{name} USING (peer, zone, term) GROUP BY peer, urn),
        ranked{name} AS (SELECT peer, urn, score, row_number() OVER (PARTITION BY peer ORDER BY round(score, 9) DESC, urn) AS result_rank FROM scores{name} {f'WHERE found = {len(set(words))}' if every else ''}),
        found{name} AS (SELECT peer, CAST(result_rank AS INTEGER) AS result_rank, urn, round(score, 6) + 0.0 AS score FROM ranked{name} WHERE result_rank <= {k})"""


def _found(zones: dict[str, float], **options) -> str:
    return f"{INDEX}, {_search(zones, **options)} SELECT * FROM found"


TITLE_ABSTRACT = {"title": 0.6, "abstract": 0.4}
EDGES = "edges AS MATERIALIZED (SELECT DISTINCT c.peer, citing_urn, cited_urn FROM citations c WHERE citing_urn <> cited_urn AND EXISTS (SELECT 1 FROM papers1 p WHERE p.peer = c.peer AND p.urn = citing_urn) AND EXISTS (SELECT 1 FROM papers1 p WHERE p.peer = c.peer AND p.urn = cited_urn))"


def _walk(steps: int = 10) -> str:
    """Ten steps over nodes(peer, urn) and edges(peer, citing_urn, cited_urn)."""
    parts = [
        "n AS (SELECT peer, count(*) AS n FROM nodes GROUP BY peer)",
        "outs AS (SELECT peer, citing_urn AS urn, count(*) AS o FROM edges GROUP BY ALL)",
        "x0 AS MATERIALIZED (SELECT peer, urn, CAST(n AS DOUBLE) AS n, coalesce(o, 0) AS o, 1.0 / n AS rank FROM nodes JOIN n USING (peer) LEFT JOIN outs USING (peer, urn))",
    ]
    for i in range(steps):
        parts.append(
            f"""x{i + 1} AS MATERIALIZED (SELECT x.peer, x.urn, x.n, x.o, (0.15 * s.total + 0.85 * s.lost) / x.n + 0.85 * coalesce(g.given, 0) AS rank FROM x{i} x
            JOIN (SELECT peer, sum(rank) AS total, sum(CASE WHEN o = 0 THEN rank ELSE 0 END) AS lost FROM x{i} GROUP BY peer) s ON s.peer = x.peer
            LEFT JOIN (SELECT e.peer, e.cited_urn AS urn, sum(y.rank / y.o) AS given FROM edges e JOIN x{i} y ON y.peer = e.peer AND y.urn = e.citing_urn GROUP BY ALL) g ON g.peer = x.peer AND g.urn = x.urn)"""
        )
    return ", ".join(parts)


def _settled(batches: int = 3) -> str:
    """The ranks after the first batch of ten steps whose last one changed them by less than 0.01 a paper."""
    change = lambda k: f"(SELECT a.peer, sqrt(sum((a.rank - b.rank) * (a.rank - b.rank))) / any_value(a.n) < 0.01 AS settled FROM x{k} a JOIN x{k - 1} b USING (peer, urn) GROUP BY a.peer)"
    done = " ".join(f"WHEN c{k}.settled THEN x{k}.rank" for k in range(10, 10 * batches, 10))
    joins = " ".join(f"JOIN {change(k)} c{k} USING (peer)" + (f" JOIN x{k} USING (peer, urn)" if k > 10 else "") for k in range(10, 10 * batches, 10))
    return f"SELECT peer, urn, round(CASE {done} ELSE x{10 * batches}.rank END, 6) AS rank FROM x10 {joins} JOIN x{10 * batches} USING (peer, urn)"


RANKS = f"WITH {PAPERS}, {EDGES}, nodes AS (SELECT peer, urn FROM papers1), {_walk()}"

REF_TOKEN = """CASE WHEN regexp_matches(t, '\\.$') THEN regexp_replace(t, '\\.$', '') WHEN regexp_matches(t, ',$') THEN regexp_replace(t, ',$', '') WHEN regexp_matches(t, ';$') THEN replace(t, ';', '')
    WHEN regexp_matches(t, ':$') THEN regexp_replace(t, ':$', '') WHEN regexp_matches(t, '^\\([a-z]*\\)$') THEN regexp_replace(regexp_replace(t, '^\\(', ''), '\\)$', '')
    WHEN regexp_matches(t, '^\\(') THEN regexp_replace(t, '^\\(', '') WHEN regexp_matches(t, '\\)$') THEN regexp_replace(t, '\\)$', '') ELSE t END"""
REFS = f"""refs1 AS (SELECT peer, citing_urn, ref_pos, any_value(title) AS title, any_value(cited_urn) AS known FROM bib_refs WHERE title IS NOT NULL AND citing_urn IS NOT NULL GROUP BY peer, citing_urn, ref_pos),
    refs AS MATERIALIZED (SELECT peer, citing_urn, ref_pos, known, list_filter(flatten(list_transform(string_split_regex(lower(title), '{SPACE}'), lambda t: string_split({REF_TOKEN}, '-'))), lambda w: w <> '') AS query FROM refs1)"""


def _links(alpha: float = 0.90, gate: str = "", where: str = "", k: int = 5) -> str:
    return f"""{INDEX}, {REFS},
        asked AS (SELECT peer, citing_urn, ref_pos, term, count(*) AS m FROM (SELECT peer, citing_urn, ref_pos, unnest(query) AS term FROM refs {where}) GROUP BY ALL),
        wq AS (SELECT peer, citing_urn, ref_pos, zone, term, m, m * idf AS wq, sqrt(sum(m * m * idf * m * idf) OVER (PARTITION BY peer, citing_urn, ref_pos, zone)) AS norm FROM asked JOIN idf USING (peer, term) WHERE zone IN ('title', 'abstract')),
        scores AS (SELECT peer, citing_urn, ref_pos, urn, sum(CASE zone WHEN 'title' THEN {alpha} ELSE 1 - {alpha} END * weight * CASE WHEN norm > 0 THEN m * wq / norm ELSE 0 END) AS score FROM wq JOIN postings USING (peer, zone, term) GROUP BY ALL),
        best AS (SELECT * FROM scores {gate} QUALIFY row_number() OVER (PARTITION BY peer, citing_urn, ref_pos ORDER BY round(score, 9) DESC, urn) <= {k}),
        cand AS (SELECT b.*, r.query, list_filter(string_split_regex(lower(p.title), '{SPACE}'), lambda w: w <> '') AS candidate FROM best b JOIN papers1 p USING (peer, urn) JOIN refs r USING (peer, citing_urn, ref_pos) WHERE b.urn <> b.citing_urn),
        measured AS (SELECT *, len(list_filter(candidate, lambda w: list_contains(query, w))) / nullif(CAST(len(candidate) AS DOUBLE), 0) AS overlap FROM cand),
        links AS (SELECT peer, citing_urn, ref_pos, urn AS cited_urn, round(overlap, 6) AS overlap FROM measured WHERE overlap > 0.85 QUALIFY row_number() OVER (PARTITION BY peer, citing_urn, ref_pos ORDER BY overlap DESC, urn) = 1)"""


CENTROID = f"""{INDEX}, own AS (SELECT * FROM postings WHERE zone = 'abstract'), docs AS (SELECT peer, count(DISTINCT urn) AS n FROM own GROUP BY peer),
    mean AS (SELECT peer, term, sum(weight) / any_value(n) AS m FROM own JOIN docs USING (peer) GROUP BY peer, term),
    lengths AS (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY peer)) AS len FROM mean),
    centroid AS MATERIALIZED (SELECT peer, term, m / len AS weight FROM lengths WHERE len > 0),
    placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY peer ORDER BY round(weight, 9) DESC, term) AS place FROM centroid)"""
SIMILAR = f"""{CENTROID}, top50 AS MATERIALIZED (SELECT * FROM placed WHERE place <= 50), plen AS (SELECT peer, sqrt(sum(weight * weight)) AS len FROM top50 GROUP BY peer),
    unit AS (SELECT peer, term, weight / len AS w FROM top50 JOIN plen USING (peer) WHERE len > 0),
    sims AS MATERIALIZED (SELECT a.peer AS peer_a, b.peer AS peer_b, sum(a.w * b.w) AS sim FROM unit a JOIN unit b USING (term) GROUP BY ALL),
    buddies AS MATERIALIZED (SELECT peer_a AS peer, peer_b AS buddy, sim, CAST(row_number() OVER (PARTITION BY peer_a ORDER BY round(sim, 9) DESC, peer_b) AS INTEGER) AS buddy_rank FROM sims WHERE peer_a <> peer_b AND sim > 0 QUALIFY buddy_rank <= 2)"""


def _score_of(text: str) -> str:
    low, head = f"lower({text})", f"substring(lower({text}), 1, 3000)"
    return f"""(CASE WHEN contains({head}, 'abstract') OR contains({head}, 'summary') THEN 2.0 WHEN contains({low}, 'abstract') OR contains({low}, 'summary') THEN 1.0 ELSE 0.0 END
        + CASE WHEN contains({low}, 'introduction') THEN 1.0 WHEN contains({low}, 'ntroduction') THEN 0.5 ELSE 0.0 END + CASE WHEN contains({low}, 'conclusion') THEN 1.0 WHEN contains({low}, 'onclusion') THEN 0.5 ELSE 0.0 END
        + CASE WHEN contains({low}, 'references') THEN 1.0 WHEN contains({low}, 'eferences') THEN 1.5 WHEN contains({low}, 'bibliography') THEN 1.0 ELSE 0.0 END)"""


SQL = {
    "tokenize_zone": f"WITH {BASE} SELECT peer, zone, urn, count(*) AS n_terms, min(term) AS first_term, max(term) AS last_term FROM terms GROUP BY peer, zone, urn",
    "stopword_filter": f"WITH {BASE} SELECT peer, zone, count(*) AS before, count(*) FILTER (term NOT IN ({STOPS})) AS after FROM clean WHERE term <> '' GROUP BY peer, zone",
    "term_frequency": f"WITH {BASE} SELECT peer, zone, urn, term, CAST(count(*) AS INTEGER) AS tf FROM terms GROUP BY ALL",
    "document_frequency_idf": f"{INDEX} SELECT peer, zone, term, df, round(idf, 6) AS idf FROM idf",
    "tfidf_postings": f"{INDEX} SELECT peer, zone, urn, term, CAST(tf AS INTEGER) AS tf, round(weight, 6) AS weight FROM postings",
    "doc_norms": f"{INDEX} SELECT peer, zone, urn, round(sqrt(sum(weight * weight)), 6) AS norm FROM postings GROUP BY ALL",
    "index_stats": f"WITH {BASE} SELECT peer, zone, count(DISTINCT term) AS terms, count(DISTINCT urn) AS papers, count(DISTINCT term) * count(DISTINCT urn) AS cells FROM terms GROUP BY peer, zone",
    "term_doc_matrix_export": f"{INDEX}, t AS (SELECT * FROM postings WHERE zone = 'title'), ids AS (SELECT peer, count(DISTINCT urn) AS n FROM t GROUP BY peer) SELECT peer, term, CAST(any_value(n) AS INTEGER) AS cells, CAST(count(*) FILTER (round(weight, 3) > 0) AS INTEGER) AS filled FROM t JOIN ids USING (peer) GROUP BY peer, term",
    "vocabulary_export": f"WITH {BASE} SELECT peer, string_agg(DISTINCT urn, ',' ORDER BY urn) AS papers, string_agg(DISTINCT term, ',' ORDER BY term) AS terms FROM terms WHERE zone = 'title' GROUP BY peer",
    "search_title": _found({"title": 1.0}),
    "search_abstract": _found({"abstract": 1.0}),
    "search_all": _found(TITLE_ABSTRACT),
    "search_fulltext": _found({"title": 0.40, "abstract": 0.60, "body": 0.25}),
    "search_fulltext_declared": _found({"title": 0.40, "abstract": 0.35, "body": 0.25}),
    "search_duplicate_terms": _found({"abstract": 1.0}, query=REPEATED),
    "search_and_mode": _found({"abstract": 1.0}, every=True),
    "search_batch": f"{INDEX}, {_search(TITLE_ABSTRACT, k=5, name='a')}, {_search(TITLE_ABSTRACT, query=REPEATED, k=5, name='b')} SELECT 'a' AS query_id, * FROM founda UNION ALL SELECT 'b', * FROM foundb",
    "author_search": f"WITH {PAPERS} SELECT peer, urn FROM papers1 p WHERE EXISTS (SELECT 1 FROM paper_authors a WHERE a.peer = p.peer AND a.urn = p.urn AND list_contains(string_split_regex(lower(author_name), '{SPACE}'), 'guadalupe'))",
    "citation_counts": f"WITH {PAPERS} SELECT p.peer, p.urn, count(DISTINCT citing_urn) AS cited_by FROM papers1 p LEFT JOIN citations c ON c.peer = p.peer AND c.cited_urn = p.urn GROUP BY p.peer, p.urn",
    "cited_by": f"WITH {PAPERS}, {EDGES}, top AS (SELECT peer, cited_urn FROM edges GROUP BY peer, cited_urn QUALIFY row_number() OVER (PARTITION BY peer ORDER BY count(*) DESC, cited_urn) = 1) SELECT peer, cited_urn, citing_urn FROM edges JOIN top USING (peer, cited_urn)",
    "search_enriched": f"{INDEX}, {_search({'title': 1.0}, k=3)} SELECT f.peer, result_rank, f.urn, p.title, (SELECT count(DISTINCT citing_urn) FROM citations c WHERE c.peer = f.peer AND c.cited_urn = f.urn) AS cited_by FROM found f JOIN papers1 p USING (peer, urn)",
    "link_citations": f"{_links()} SELECT * FROM links",
    "link_citations_gated": f"{_links(0.95, 'WHERE true')} SELECT DISTINCT peer, citing_urn, cited_urn FROM (SELECT peer, citing_urn, ref_pos, urn AS cited_urn FROM measured WHERE score > 0.20 AND overlap > 0.85 QUALIFY row_number() OVER (PARTITION BY peer, citing_urn, ref_pos ORDER BY overlap DESC, urn) = 1)",
    "link_citations_incremental": f"{_links(where='WHERE known IS NULL')} SELECT DISTINCT peer, citing_urn, cited_urn FROM links",
    "link_evaluation": f"""{_links()}, f AS (SELECT DISTINCT peer, citing_urn, cited_urn FROM links WHERE citing_urn IN (SELECT citing_urn FROM citations)), t AS (SELECT DISTINCT peer, citing_urn, cited_urn FROM citations),
        c AS (SELECT count(*) FILTER (f.peer IS NOT NULL AND t.peer IS NOT NULL) AS tp, count(*) FILTER (t.peer IS NULL) AS fp, count(*) FILTER (f.peer IS NULL) AS fn FROM f FULL JOIN t ON f.peer = t.peer AND f.citing_urn = t.citing_urn AND f.cited_urn = t.cited_urn)
        SELECT tp, fp, fn, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision, round(CAST(tp AS DOUBLE) / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
    "reference_overlap": f"WITH {REFS} SELECT citing_urn, ref_pos, array_to_string(query, ' ') AS tokens FROM refs",
    "pagerank": f"{RANKS} SELECT peer, urn, round(rank, 6) AS rank FROM x10",
    "pagerank_color_scale": f"{RANKS}, l AS (SELECT peer, urn, ln(rank / min(rank) OVER (PARTITION BY peer)) AS l FROM x10) SELECT peer, urn, CAST(ceil(round(coalesce(10 * (l * 0.6 / nullif(max(l) OVER (PARTITION BY peer), 0)), 0), 9)) + 1 AS INTEGER) AS color FROM l",
    "pagerank_lineitem": f"""WITH nodes AS (SELECT 'all' AS peer, p_partkey AS urn FROM part), edges AS MATERIALIZED (SELECT DISTINCT 'all' AS peer, a AS citing_urn, b AS cited_urn FROM
        (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem WHERE l_returnflag = 'R') WHERE a > b), {_walk()} SELECT urn, round(rank, 9) AS rank FROM x10""",
    "dangling_nodes": f"WITH {PAPERS}, {EDGES} SELECT peer, urn FROM papers1 p WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.peer = p.peer AND e.citing_urn = p.urn)",
    "citation_components": f"""WITH RECURSIVE {PAPERS}, {EDGES}, sym AS (SELECT citing_urn AS a, cited_urn AS b FROM edges UNION SELECT cited_urn, citing_urn FROM edges),
        reach AS (SELECT a AS urn, a AS r FROM sym UNION SELECT reach.urn, sym.b FROM reach JOIN sym ON sym.a = reach.r) SELECT urn, min(r) AS component FROM reach GROUP BY urn""",
    "peer_centroid": f"{CENTROID} SELECT peer, term, round(weight, 6) AS weight FROM centroid",
    "peer_rss": f"""{CENTROID}, d AS (SELECT o.peer, o.urn, sum(o.weight * o.weight) AS dd, sum(o.weight * c.weight) AS dc FROM own o JOIN centroid c USING (peer, term) GROUP BY ALL)
        SELECT peer, count(*) AS n_docs, round(sum(dd - 2 * dc + 1), 6) AS rss FROM d GROUP BY peer""",
    "centroid_top50": f"{CENTROID} SELECT peer, term, round(weight, 6) AS weight, CAST(place AS INTEGER) AS place FROM placed WHERE place <= 50",
    "centroid_ratio": f"{CENTROID} SELECT peer, round(sqrt(sum(weight * weight) FILTER (place <= 50)) / sqrt(sum(weight * weight)), 6) AS ratio FROM placed GROUP BY peer",
    "peer_similarity": f"{SIMILAR} SELECT peer_a, peer_b, round(sim, 6) AS sim FROM sims",
    "taste_buddies": f"{SIMILAR} SELECT peer, buddy_rank, buddy, round(sim, 6) AS sim FROM buddies",
    "friendship_stats": f"{SIMILAR}, p AS (SELECT DISTINCT peer FROM papers1), b AS (SELECT peer, count(*) AS n FROM buddies GROUP BY peer) SELECT count(*) AS peers, count(*) FILTER (n IS NULL) AS alone, CAST(coalesce(sum(n), 0) AS BIGINT) AS friendships FROM p LEFT JOIN b USING (peer)",
    "recommendations": f"""{SIMILAR}, asked AS (SELECT b.peer AS asker, b.buddy AS peer, term FROM buddies b JOIN top50 t ON t.peer = b.peer),
        q AS (SELECT asker, peer, term, idf, sqrt(sum(idf * idf) OVER (PARTITION BY asker, peer)) AS norm FROM asked JOIN idf USING (peer, term) WHERE zone = 'title'),
        s AS (SELECT asker, peer, urn, sum(weight * CASE WHEN norm > 0 THEN idf / norm ELSE 0 END) AS score FROM q JOIN postings p USING (peer, term) WHERE p.zone = 'title' GROUP BY ALL)
        SELECT asker AS peer, peer AS buddy, urn, round(score, 6) + 0.0 AS score, CAST(row_number() OVER (PARTITION BY asker, peer ORDER BY round(score, 9) DESC, urn) AS INTEGER) AS result_rank FROM s QUALIFY result_rank <= 2""",
    "p2p_search": f"""{SIMILAR}, {_search(TITLE_ABSTRACT, name='l')}, {_search({'title': 0.40, 'abstract': 0.60, 'body': 0.25}, k=4, name='b')}
        SELECT peer AS origin, result_rank, urn, score FROM foundl WHERE peer = '{BUDDY_PEER}' UNION ALL SELECT peer, result_rank, urn, score FROM foundb WHERE peer IN (SELECT buddy FROM buddies WHERE peer = '{BUDDY_PEER}')""",
    "tag_cloud": f"""{CENTROID}, t AS (SELECT peer, term, weight, least(min(weight) OVER (PARTITION BY peer), 1.0) AS lo, greatest(max(weight) OVER (PARTITION BY peer), 0.0) AS hi FROM placed WHERE place <= 30)
        SELECT peer, term, CAST(ceil(round(6 + 20 * (weight - lo) / (hi - lo), 9)) AS INTEGER) AS font FROM t WHERE hi > lo""",
    "paper_classifier": f"SELECT doc_id, CAST({_score_of('text')} AS DOUBLE) AS score, {_score_of('text')} > 1.99 AS paper FROM documents",
    "link_citations_oldest": f"{_links(k=3)} SELECT DISTINCT peer, citing_urn, cited_urn FROM (SELECT peer, citing_urn, ref_pos, urn AS cited_urn FROM measured WHERE score > 0.40 AND overlap > 0.85 QUALIFY row_number() OVER (PARTITION BY peer, citing_urn, ref_pos ORDER BY overlap DESC, urn) = 1)",
    "build_and_analyse": f"{_links()}, nodes AS (SELECT peer, urn FROM papers1), edges AS MATERIALIZED (SELECT DISTINCT l.peer, citing_urn, cited_urn FROM links l JOIN papers1 p ON p.peer = l.peer AND p.urn = l.citing_urn), {_walk(30)} {_settled()}",
    "graph_counters": f"""{_links(where='WHERE known IS NULL')}, strings AS (SELECT peer, citing_urn, ref_pos, max(cited_urn) AS known FROM bib_refs WHERE citing_urn IS NOT NULL AND ref_pos IS NOT NULL GROUP BY ALL), added AS (SELECT peer, count(*) AS n FROM links GROUP BY peer)
        SELECT s.peer, count(DISTINCT citing_urn) AS papers_citing, count(*) AS strings_total, count(*) FILTER (known IS NULL) AS strings_analysed, coalesce(any_value(n), 0) AS edges_added FROM strings s LEFT JOIN added USING (peer) GROUP BY s.peer""",
    "adjacency_dump": f"WITH {PAPERS}, {EDGES} SELECT p.peer, p.urn, string_agg(CASE WHEN e.peer IS NULL THEN '0 ' ELSE '1 ' END, '' ORDER BY q.urn) AS line FROM papers1 p JOIN papers1 q USING (peer) LEFT JOIN edges e ON e.peer = p.peer AND e.citing_urn = p.urn AND e.cited_urn = q.urn GROUP BY p.peer, p.urn",
    "author_filter": r"""WITH a AS (SELECT urn, author_pos, any_value(author_name) AS n FROM paper_authors GROUP BY urn, author_pos), l AS (SELECT urn, string_agg(n, ', ' ORDER BY author_pos) AS line FROM a GROUP BY urn),
        p AS (SELECT urn, list_filter(string_split_regex(regexp_replace(line, ',\s*$', ''), '\s*,|\n+|\s+and\s+|^\s*and\s+|\s+AND\s+'), lambda x: length(x) > 0 AND length(x) < 35) AS pieces FROM l
            WHERE NOT regexp_matches(line, '[0-9@&]') AND NOT regexp_matches(line, 'Berkeley|College|Computer|Department|Engineering|IEEE|Institute|Laboratory|Member|Microsoft|Netherlands|Project|Report|Research|School|Science|Technology|Universit')),
        w AS (SELECT urn, list_transform(pieces, lambda x: list_filter(string_split_regex(x, '\s+'), lambda y: y <> '')) AS words FROM p)
        SELECT urn, unnest(list_transform(words, lambda x: array_to_string(x, ' '))) AS author_name FROM w WHERE len(list_filter(words, lambda x: len(x) NOT BETWEEN 2 AND 3 OR NOT regexp_matches(x[1], '^[A-Z]') OR NOT regexp_matches(x[-1], '^[A-Z]'))) = 0""".replace("\\\\", "\\"),
    "hamming_distance": "SELECT a.n_name AS a, b.n_name AS b, CAST(hamming(upper(a.n_name), upper(b.n_name)) AS INTEGER) AS distance FROM nation a JOIN nation b ON length(a.n_name) = length(b.n_name)",
    "clean_titles": f"SELECT urn, trim(regexp_replace(replace(replace(replace(replace(any_value(title), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), '{SPACE}+', ' ', 'g')) AS title FROM papers WHERE title IS NOT NULL GROUP BY urn",
    "known_resources": "WITH r AS (SELECT peer, nullif(regexp_extract(resource_url, '([^/]+)\\.[^./]+$', 1), '') AS resource_key FROM papers) SELECT DISTINCT resource_key FROM r WHERE resource_key IS NOT NULL AND resource_key NOT IN (SELECT resource_key FROM r WHERE peer = 'mirelo' AND resource_key IS NOT NULL)",
    "peer_presence": """WITH e AS (SELECT DISTINCT peer, ts FROM peer_events WHERE peer IS NOT NULL AND ts IS NOT NULL), g AS (SELECT peer, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY peer ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM e),
        s AS (SELECT peer, ts, sum(fresh) OVER (PARTITION BY peer ORDER BY ts) AS k FROM g) SELECT peer, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS seen_from, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS seen_to FROM s GROUP BY peer, k""",
    "peer_liveness": """WITH e AS (SELECT peer, ts, kind FROM peer_events WHERE peer IS NOT NULL AND ts <= TIMESTAMPTZ '2009-01-20 00:00:00+00'), l AS (SELECT peer, ts, CASE WHEN kind = 'leave' THEN 1 ELSE 0 END AS left_ FROM e QUALIFY row_number() OVER (PARTITION BY peer ORDER BY ts DESC, CASE WHEN kind = 'leave' THEN 1 ELSE 0 END DESC) = 1)
        SELECT peer, strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_seen, ts >= TIMESTAMPTZ '2009-01-19 00:00:00+00' AND left_ = 0 AS live FROM l""",
    "peer_ports": """WITH j AS (SELECT peer, ts, coalesce(address, '') AS address FROM peer_events WHERE kind = 'join' AND peer IS NOT NULL QUALIFY row_number() OVER (PARTITION BY peer ORDER BY ts, coalesce(address, '')) = 1)
        SELECT peer, address, CAST(16200 + row_number() OVER (PARTITION BY address ORDER BY ts, peer) AS INTEGER) AS port FROM j WHERE address <> ''""",
    "latest_profile": "WITH p AS (SELECT peer, ts, min(kind) AS profile FROM peer_events WHERE peer IS NOT NULL GROUP BY peer, ts) SELECT peer, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts, max_by(profile, ts) AS profile FROM p GROUP BY peer",
    "stream_presence": """WITH e AS (SELECT peer, ts, count(*) AS n FROM peer_events WHERE peer IS NOT NULL AND ts IS NOT NULL GROUP BY peer, ts), g AS (SELECT peer, n, CASE WHEN ts < lag(ts) OVER (PARTITION BY peer ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM e)
        SELECT peer, CAST(sum(fresh) AS BIGINT) AS stretches, CAST(sum(n) AS BIGINT) AS events FROM g GROUP BY peer""",
    "embedding_neighbors": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT a.vec_id, b.vec_id AS neighbour, round(list_cosine_similarity(a.e, b.e), 6) AS sim,
        CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.vec_id) AS INTEGER) AS place FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY place <= 5""",
    "document_cosines": f"""{INDEX}, own AS (SELECT peer, urn, term, weight FROM postings WHERE zone = 'abstract'), s AS (SELECT a.peer, a.urn AS urn_a, b.urn AS urn_b, sum(a.weight * b.weight) AS sim FROM own a JOIN own b USING (peer, term)
        WHERE a.urn <> b.urn AND CAST(substring(a.urn, 4, 9) AS INTEGER) % 20 = 0 GROUP BY ALL) SELECT peer, urn_a, urn_b, round(sim, 6) AS sim FROM s WHERE round(sim, 6) >= 0.3""",
}
