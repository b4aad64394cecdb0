"""Queries of vectors, search, graphs, chunks and mining."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fernloom.functions import text as T
from fernloom.operators import chunking, graph, mining, ranking, search, vectors
from fernloom.session import load

C = F.col
TERMS = ["the", "tion", "and"]


def _query(spark, d):
    return [float(x) for x in load(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


def knn_topk(spark, d):
    rows = load(spark, d, "embeddings")
    return vectors.nearest(rows.where("vec_id <> 0"), _query(spark, d), 10, -1.0).withColumn("similarity", F.round("similarity", 6))


COS = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
KNN = f"SELECT e.vec_id, round({COS.format('e.embedding', 'q.embedding')}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0 ORDER BY {COS.format('e.embedding', 'q.embedding')} DESC, vec_id LIMIT 10"


def similar_documents(spark, d):
    """The five nearest of every twentieth vector, among all."""
    rows = load(spark, d, "embeddings")
    return vectors.neighbours(rows.where("vec_id % 20 = 0"), rows, 5, 0.0).select("query_id", "vec_id", "similarity")


SIMILAR = f"SELECT q.vec_id AS query_id, e.vec_id, round({COS.format('e.embedding', 'q.embedding')}, 6) AS similarity FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id WHERE similarity >= 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY similarity DESC, e.vec_id) <= 5"


def similarity_edges(spark, d):
    return vectors.similarity_edges(load(spark, d, "embeddings"), 0.3)


EDGES = f"SELECT x.vec_id AS a, y.vec_id AS b, round({COS.format('x.embedding', 'y.embedding')}, 6) AS similarity FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE similarity >= 0.3"


def similarity_stats(spark, d):
    """Mean, deviation, extremes, median hundredth and buckets of all pairs."""
    return vectors.similarity_summary(load(spark, d, "embeddings"))


STATS = f"""WITH s AS (SELECT round({COS.format('x.embedding', 'y.embedding')}, 6) AS s FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id), h AS (SELECT floor(s * 100) AS step, count(*) AS n FROM s GROUP BY 1), u AS (SELECT step, sum(n) OVER (ORDER BY step) AS upto, sum(n) OVER () AS total FROM h)
SELECT count(*) AS n, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS dev, min(s) AS low, max(s) AS high, (SELECT min(step) / 100 FROM u WHERE upto * 2 >= total) AS median, count(*) FILTER (s >= 0.8) AS near, count(*) FILTER (s >= 0.5 AND s < 0.8) AS middle, count(*) FILTER (s < 0.5) AS far FROM s"""


def centroids(spark, d):
    m = vectors.mean_vectors(load(spark, d, "embeddings"), "label")
    return m.select("label", "n", F.posexplode("mean").alias("i", "x")).select("label", "n", "i", F.round("x", 6).alias("x"))


CENTROIDS = "SELECT label, count(*) AS n, CAST(i - 1 AS INTEGER) AS i, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i"


def _docs(spark, d):
    return load(spark, d, "documents")


def fts_bm25(spark, d):
    return search.bm25(_docs(spark, d), TERMS).orderBy(F.desc("score"), "doc_id").limit(20)


def _bm25_sql(docs: str = "documents") -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(TERMS))
    score = " + ".join(f"ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * (tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * n / mean)))" for i in range(len(TERMS)))
    return f"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM {docs}), t AS (SELECT doc_id, len(w) AS n, {tf} FROM w),
s AS (SELECT count(*) AS docs, avg(n) AS mean, {", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(TERMS)))} FROM t),
bm AS (SELECT doc_id, round({score}, 6) AS score FROM t, s WHERE {" OR ".join(f"tf{i} > 0" for i in range(len(TERMS)))})"""


def token_scorer(spark, d):
    text = F.lower("text")
    return _docs(spark, d).select("doc_id", search.token_score(F.substring(text, 1, 60), text, TERMS).alias("score")).where("score > 0")


TOKEN = "SELECT doc_id, score FROM (SELECT doc_id, " + " + ".join(f"CASE WHEN contains(substr(lower(text), 1, 60), '{t}') THEN 3 ELSE 0 END + (length(lower(text)) - length(replace(lower(text), '{t}', ''))) / {len(t)}" for t in TERMS) + " AS score FROM documents) WHERE score > 0"


def inverted_index(spark, d):
    """Terms by the number of documents that have them, the hundred most frequent."""
    return search.postings(_docs(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("uses")).orderBy(F.desc("df"), "term").limit(100)


INDEX = "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS uses FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) GROUP BY ALL) GROUP BY term ORDER BY df DESC, term LIMIT 100"


def hybrid_search(spark, d):
    """Keyword and vector hits fused by rank; the position decays at the end."""
    key = search.bm25(_docs(spark, d), TERMS).orderBy(F.desc("score"), "doc_id").limit(40)
    vec = vectors.nearest(load(spark, d, "embeddings"), _query(spark, d), 40, -1.0).select(C("vec_id").alias("doc_id"), F.round("similarity", 6).alias("score"))
    both = search.fused([search.ranked(key), search.ranked(vec)], [0.5, 0.5])
    return ranking.decayed(both, "score", [F.desc("score"), C("doc_id")], 30).select("doc_id", F.round("score", 6).alias("score"))


HYBRID = f"""WITH {_bm25_sql()}, k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM bm QUALIFY r <= 40),
v0 AS (SELECT e.vec_id AS doc_id, round({COS.format('e.embedding', 'q.embedding')}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q), v AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM v0 QUALIFY r <= 40),
u AS (SELECT doc_id, sum(0.5 / (60 + r)) + CASE WHEN count(*) = 2 THEN 0.1 ELSE 0 END AS score FROM (SELECT * FROM k UNION ALL SELECT * FROM v) GROUP BY 1), z AS (SELECT doc_id, round(score / (SELECT max(score) FROM u), 6) AS score FROM u),
p AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS place FROM z) SELECT doc_id, round(score * (1 - 0.02 * place), 6) AS score FROM p WHERE place < 30"""


def autocomplete(spark, d):
    return search.autocomplete(load(spark, d, "part"), "p_type", "s", 10)


AUTO = "SELECT p_type, n, count(*) OVER () AS matches FROM (SELECT p_type, count(*) AS n FROM part WHERE starts_with(lower(p_type), 's') GROUP BY 1) ORDER BY n DESC, p_type LIMIT 10"


def fuzzy_names(spark, d):
    """Names within two edits of a query."""
    return load(spark, d, "nation").select("n_name", F.levenshtein(F.lower("n_name"), F.lit("nation_1")).cast("long").alias("distance")).where("distance <= 2")


def snippets(spark, d):
    return _docs(spark, d).select("doc_id", search.snippet(C("text"), TERMS).alias("snippet"))


_HITS = " + ".join(f"CAST(contains(lower(s), '{t}') AS INTEGER)" for t in TERMS)
SNIPPETS = f"""WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda s: trim(s, ' ')), lambda s: length(s) >= 10)) AS s, generate_subscripts(list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda s: trim(s, ' ')), lambda s: length(s) >= 10), 1) AS i FROM documents),
b AS (SELECT doc_id, s FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {_HITS} DESC, i) = 1) SELECT doc_id, substr(coalesce(s, ''), 1, 200) AS snippet FROM documents LEFT JOIN b USING (doc_id)"""


def rag_context(spark, d):
    """The five best sources as one numbered context."""
    hits = search.bm25(_docs(spark, d), TERMS).orderBy(F.desc("score"), "doc_id").limit(5).join(_docs(spark, d), "doc_id")
    n = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))
    block = F.concat(F.lit("[Source "), n.cast("string"), F.lit("] "), F.substring("text", 1, 40))
    return hits.select(n.alias("n"), block.alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "block"))), lambda s: s["block"]), "\n---\n").alias("context"))


RAG = f"""WITH {_bm25_sql()}, h AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS n FROM bm QUALIFY n <= 5) SELECT string_agg('[Source ' || n || '] ' || substr(text, 1, 40), chr(10) || '---' || chr(10) ORDER BY n) AS context FROM h JOIN documents USING (doc_id)"""


def _graph(spark, d):
    """Brands that are ordered together in the large orders."""
    rows = load(spark, d, "lineitem").where("l_quantity > 45").join(load(spark, d, "part"), C("l_partkey") == C("p_partkey")).select("l_orderkey", F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("g"))
    return graph.shared_members(rows.select("l_orderkey", "g").distinct(), 2)


GRAPH = "m AS (SELECT DISTINCT l_orderkey, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS g FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45), e AS (SELECT x.g AS a, y.g AS b, CAST(count(*) AS DOUBLE) AS weight FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.g < y.g GROUP BY ALL HAVING count(*) >= 2), l AS (SELECT * FROM e UNION ALL SELECT b, a, weight FROM e)"


def graph_edges(spark, d):
    return _graph(spark, d)


def graph_nodes(spark, d):
    return graph.node_statistics(_graph(spark, d))


def shortest_paths(spark, d):
    return graph.distances(_graph(spark, d), 11, 4)


def graph_paths(spark, d):
    """The path from one node to each that is within four steps."""
    return graph.paths(_graph(spark, d), 11, 4).select("node", "distance", F.array_join("path", " > ").alias("path"))


GRAPH_PATHS = """p AS (SELECT 11::BIGINT AS node, 0 AS distance UNION SELECT l.b, distance + 1 FROM p JOIN l ON l.a = p.node WHERE distance < 4), s AS (SELECT node, min(distance) AS distance FROM p WHERE 11 IN (SELECT a FROM l) GROUP BY 1),
b AS (SELECT s.node, s.distance, (SELECT min(l.a) FROM l JOIN s q ON q.node = l.a WHERE l.b = s.node AND q.distance = s.distance - 1) AS before FROM s),
w AS (SELECT node, distance, CAST(node AS VARCHAR) AS path FROM b WHERE distance = 0 UNION ALL SELECT b.node, b.distance, w.path || ' > ' || b.node FROM w JOIN b ON b.before = w.node AND b.distance = w.distance + 1)
SELECT node, distance, path FROM w"""


def communities(spark, d):
    return graph.communities(_graph(spark, d), 3)


def chunk_fixed(spark, d):
    return chunking.fixed(_docs(spark, d), 100, 20)


_W = r"regexp_extract_all(text, '[^ \t\n\r\f\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')"
CHUNKS = f"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) <= 100 THEN 1 ELSE CAST(ceil((len(w) - 100) / 80) AS BIGINT) + 1 END)) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(i AS INTEGER) AS index, array_to_string(w[i * 80 + 1:i * 80 + 100], ' ') AS text, CAST(len(w[i * 80 + 1:i * 80 + 100]) AS INTEGER) AS n_words FROM i"""


def chunk_sentences(spark, d):
    s = _docs(spark, d).select("doc_id", chunking.sentences(C("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.sha2(F.array_join("s", "\n"), 256).alias("hash"))


def chunk_paragraphs(spark, d):
    p = chunking.paragraphs(_docs(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))), 200)
    return p.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("text")).cast("long").alias("longest"))


def tfidf_terms(spark, d):
    w = mining.tfidf(_docs(spark, d)).select("doc_id", "term", F.round("weight", 6).alias("weight"))
    return ranking.newest(w, ["doc_id"], [F.desc("weight"), C("term")], 3)


_S = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TFIDF = f"""t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) WHERE length(term) > 2 AND term NOT IN ({_S}) GROUP BY ALL),
n AS (SELECT count(*) AS docs FROM documents), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1), r AS (SELECT doc_id, term, tf * (ln((1 + docs) / (1 + df)) + 1) AS w FROM t JOIN f USING (term), n WHERE df >= 2 AND df <= 0.8 * docs),
z AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM r)"""


def similar_texts(spark, d):
    """The three texts most like each of the stated query set, every twentieth, among all."""
    docs = _docs(spark, d)
    return mining.similar_texts(mining.tfidf(docs), docs.where("doc_id % 20 = 0"), 3).where("similarity > 0.05")


SIMILAR_TEXTS = f"WITH {_TFIDF}, s AS (SELECT q.doc_id AS query, z.doc_id, round(sum(q.weight * z.weight), 6) AS similarity FROM z q JOIN z ON q.term = z.term AND q.doc_id <> z.doc_id WHERE q.doc_id % 20 = 0 GROUP BY ALL) SELECT * FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, doc_id) <= 3) WHERE similarity > 0.05"


def _asked(spark, d):
    """Queries made of the parts' names."""
    k, name = C("p_partkey") % 3, C("p_name")
    return load(spark, d, "part").select("p_partkey", F.when(k == 0, F.concat(F.lit("How to find the best "), name, F.lit(" error"))).when(k == 1, F.concat(F.lit("very simply "), name)).otherwise(F.concat(F.lit("Update "), name)).alias("q"))


def query_expansions(spark, d):
    return _asked(spark, d).select("p_partkey", F.array_join(search.expansions(C("q")), ";").alias("expansions"), F.array_join(search.matched_terms(C("q")), ";").alias("terms"))


_SWAPS = ", ".join(f"CASE WHEN contains(q, '{k}') THEN replace(q, '{k}', '{x}') END" for k, xs in search.SYNONYMS.items() for x in xs[:2])
_QUALIFIERS = ", ".join(f"'{w}'" for w in search.QUALIFIERS)
EXPANSIONS = f"""WITH a AS (SELECT p_partkey, lower(CASE p_partkey % 3 WHEN 0 THEN 'How to find the best ' || p_name || ' error' WHEN 1 THEN 'very simply ' || p_name ELSE 'Update ' || p_name END) AS q FROM part),
r AS (SELECT *, list_filter(string_split(trim(regexp_replace(q, '\\s+', ' ', 'g')), ' '), lambda w: w NOT IN ({_QUALIFIERS})) AS r FROM a)
SELECT p_partkey, array_to_string(list_filter([{_SWAPS}, CASE WHEN len(r) >= 2 THEN array_to_string(r, ' ') END], lambda x: x IS NOT NULL AND x <> q)[1:3], ';') AS expansions, array_to_string(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: strlen(w) > 2), ';') AS terms FROM r"""


def kmeans_clusters(spark, d):
    return mining.kmeans(load(spark, d, "embeddings"), 5).groupBy("cluster").agg(F.count("*").alias("n"))


QUERIES = {
    "knn_topk": (knn_topk, KNN),
    "similar_documents": (similar_documents, SIMILAR),
    "similarity_edges": (similarity_edges, EDGES),
    "similarity_stats": (similarity_stats, STATS),
    "centroids": (centroids, CENTROIDS),
    "fts_bm25": (fts_bm25, f"WITH {_bm25_sql()} SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 20"),
    "token_scorer": (token_scorer, TOKEN),
    "inverted_index": (inverted_index, INDEX),
    "hybrid_search": (hybrid_search, HYBRID),
    "autocomplete": (autocomplete, AUTO),
    "fuzzy_names": (fuzzy_names, "SELECT n_name, levenshtein(lower(n_name), 'nation_1') AS distance FROM nation WHERE levenshtein(lower(n_name), 'nation_1') <= 2"),
    "snippets": (snippets, SNIPPETS),
    "rag_context": (rag_context, RAG),
    "graph_edges": (graph_edges, f"WITH {GRAPH} SELECT * FROM e"),
    "graph_nodes": (graph_nodes, f"WITH {GRAPH} SELECT a AS node, count(*) AS degree, round(avg(weight), 6) AS mean_weight, first(b ORDER BY weight DESC, b) AS best FROM l GROUP BY 1"),
    "shortest_paths": (shortest_paths, f"WITH RECURSIVE {GRAPH}, p AS (SELECT 11::BIGINT AS node, 0 AS distance UNION SELECT l.b, distance + 1 FROM p JOIN l ON l.a = p.node WHERE distance < 4) SELECT node, min(distance) AS distance FROM p GROUP BY 1"),
    "graph_paths": (graph_paths, f"WITH RECURSIVE {GRAPH}, {GRAPH_PATHS}"),
    "communities": (communities, None),
    "chunk_fixed": (chunk_fixed, CHUNKS),
    "chunk_sentences": (chunk_sentences, None),
    "chunk_paragraphs": (chunk_paragraphs, None),
    "tfidf_terms": (tfidf_terms, f"WITH {_TFIDF} SELECT doc_id, term, round(weight, 6) AS weight FROM z QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 6) DESC, term) <= 3"),
    "similar_texts": (similar_texts, SIMILAR_TEXTS),
    "query_expansions": (query_expansions, EXPANSIONS),
    "kmeans_clusters": (kmeans_clusters, None),
}
