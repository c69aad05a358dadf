"""Search, results and reports as registered queries; each reads whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leafquire.functions import patterns as P
from leafquire.functions import text as X
from leafquire.operators import checks, citations, clusters, context, keyword, search, stored
from leafquire.plans import jobs
from leafquire.registry import query
from leafquire.sources import samples as S
from leafquire.sources.stage import kept, shared_folder, staged


def _sixth(c):
    return F.round(c, 6)


def keyword_sql(chunks: str, queries: str) -> str:
    """SQL for ranked keyword hits ``kw`` of ``q`` in ``grams``; from each place of a chunk the prefixes of phrases are followed. Goes after WITH RECURSIVE."""
    return f"""
words AS ({chunks}),
grams AS (
  SELECT chunk_id, doc_id, content_type,
    flatten(list_transform(ws, lambda w: CASE WHEN length(w) < 2 THEN [w] ELSE list_transform(generate_series(1, length(w) - 1), lambda i: substr(w, i, 2)) END)) AS gs
  FROM words),
q AS ({queries}),
qw AS (SELECT query_id, unnest(regexp_extract_all(query, '[0-9A-Za-z가-힣]+')) AS w FROM q),
ph AS (
  SELECT query_id, CASE WHEN length(w) < 2 THEN lower(w) ELSE array_to_string(list_transform(generate_series(1, length(w) - 1), lambda i: substr(lower(w), i, 2)), ' ') END AS phrase FROM qw),
dp AS (SELECT DISTINCT phrase, string_split(phrase, ' ') AS ps FROM ph),
tn AS MATERIALIZED (SELECT DISTINCT array_to_string(ps[1:i], ' ') AS node FROM (SELECT ps, unnest(generate_series(1, len(ps))) AS i FROM dp)),
post AS MATERIALIZED (SELECT chunk_id, unnest(gs) AS gram, unnest(generate_series(1, len(gs))) AS pos FROM grams),
wk(chunk_id, pos, node, k) AS (
  SELECT chunk_id, pos, gram, 1 FROM post WHERE gram IN (SELECT node FROM tn)
  UNION ALL
  SELECT wk.chunk_id, wk.pos, tn.node, k + 1 FROM wk JOIN post p ON p.chunk_id = wk.chunk_id AND p.pos = wk.pos + k JOIN tn ON tn.node = wk.node || ' ' || p.gram),
f AS MATERIALIZED (SELECT phrase, chunk_id, count(*) AS f FROM wk JOIN dp ON node = phrase GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(gs)) AS a FROM grams),
idf AS (SELECT phrase, CASE WHEN ln((n - c + 0.5) / (c + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - c + 0.5) / (c + 0.5)) END AS idf FROM (SELECT phrase, count(*) AS c FROM f GROUP BY phrase), st),
pa AS (
  SELECT phrase, f.chunk_id, idf * f * 2.2 / (f + 1.2 * (1 - 0.75::DOUBLE + 0.75::DOUBLE * (len(gs) / a))) AS part
  FROM f JOIN idf USING (phrase) JOIN grams USING (chunk_id), st),
sc AS (SELECT ph.query_id, chunk_id, -list_reduce(list_sort(list(part)), lambda x, y: x + y, 0::DOUBLE) AS score FROM ph JOIN pa USING (phrase) GROUP BY ALL),
kw AS (
  SELECT sc.query_id, sc.chunk_id, score, row_number() OVER (PARTITION BY sc.query_id ORDER BY score, sc.chunk_id) AS rank
  FROM sc JOIN q USING (query_id) JOIN grams g USING (chunk_id)
  WHERE (want_doc IS NULL OR want_doc = g.doc_id) AND (want_type IS NULL OR want_type = g.content_type))
"""


_WORDS = "SELECT doc_id::VARCHAR AS chunk_id, source AS doc_id, lang AS content_type, regexp_extract_all(lower(coalesce(text, '')), '[0-9A-Za-z가-힣]+') AS ws FROM documents"
_GRAMS = f"""words AS ({_WORDS}), grams AS (
  SELECT chunk_id, doc_id, content_type,
    flatten(list_transform(ws, lambda w: CASE WHEN length(w) < 2 THEN [w] ELSE list_transform(generate_series(1, length(w) - 1), lambda i: substr(w, i, 2)) END)) AS gs
  FROM words),
"""
_KEYWORD = "WITH RECURSIVE " + keyword_sql(_WORDS, """
  SELECT item_id::VARCHAR AS query_id, coalesce(text, '') AS query, CASE WHEN item_id % 5 = 0 THEN 'src1' END AS want_doc, CASE WHEN item_id % 3 = 0 THEN 'en' END AS want_type FROM benchmark""")


def _keyword(spark, sf):
    return keyword.keyword_search(S.queries(spark, sf), S.chunks(spark, sf))


@query(_KEYWORD + "SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM kw WHERE rank <= 100")
def keyword_search(spark, sf):
    return _keyword(spark, sf).select("query_id", "chunk_id", _sixth("score").alias("score"), "rank")


def _stored_index(spark, sf):
    path = f"{shared_folder(spark)}/leafquire-stage-index-{uuid.uuid4().hex}"
    stored.write_index(S.chunks(spark, sf), kept(path))
    return stored.read_index(spark, path)


@query(_KEYWORD + "SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM kw WHERE rank <= 100")
def stored_search(spark, sf):
    """The passages again, from a stored index alone."""
    return stored.search(S.queries(spark, sf), *_stored_index(spark, sf)).select("query_id", "chunk_id", _sixth("score").alias("score"), "rank")


@query("WITH " + _GRAMS + """
p AS (SELECT unnest(gs) AS gram FROM grams)
SELECT ascii(gram) * 2097152 + CASE WHEN length(gram) > 1 THEN ascii(substr(gram, 2)) ELSE 0 END AS term, count(*) AS n FROM p GROUP BY ALL""")
def stored_terms(spark, sf):
    return _stored_index(spark, sf)[1]


@query("WITH " + _GRAMS + """
p AS (SELECT unnest(gs) AS gram, chunk_id FROM grams)
SELECT gram, count(*) AS n, count(DISTINCT chunk_id) AS n_chunks FROM p GROUP BY gram""")
def term_statistics(spark, sf):
    return keyword.postings(S.chunks(spark, sf)).groupBy("gram").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("n_chunks"))


@query("WITH " + _GRAMS + "x AS (SELECT 1) SELECT count(*) AS n, round(avg(len(gs)), 6) AS mean_length, sum(len(gs))::BIGINT AS n_terms FROM grams")
def corpus_statistics(spark, sf):
    return keyword.lengths(S.chunks(spark, sf)).agg(F.count("*").alias("n"), _sixth(F.avg("n")).alias("mean_length"), F.sum("n").alias("n_terms"))


@query("""
WITH q AS (SELECT item_id, regexp_extract_all(CASE WHEN item_id % 7 = 3 THEN '얼마야 최대' WHEN item_id % 3 = 0 THEN text || ' 하는 경우' ELSE text END, '[0-9A-Za-z가-힣]+') AS ws FROM benchmark),
k AS (SELECT item_id, CASE WHEN item_id % 7 = 3 THEN ws WHEN item_id % 3 = 0 THEN ws[:-3] ELSE ws END AS ws FROM q)
SELECT item_id, array_to_string(ws, ' ') AS words, len(ws) AS n FROM k""")
def query_words(spark, sf):
    """Every third passage ends in question words, which go; every seventh has no others, and keeps them."""
    i = F.col("item_id")
    asked = F.when(i % 7 == 3, "얼마야 최대").when(i % 3 == 0, F.concat("text", F.lit(" 하는 경우"))).otherwise(F.col("text"))
    w = X.content_words(asked)
    return S.table(spark, sf, "benchmark").select("item_id", F.array_join(w, " ").alias("words"), F.size(w).cast("long").alias("n"))


_VECTORS = """
v AS (SELECT vec_id::VARCHAR AS id, vec_id, 'g' || label AS grp, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS e FROM embeddings),
vd AS (
  SELECT (a.vec_id // 100)::VARCHAR AS query_id, b.id AS chunk_id, list_distance(a.e, b.e) AS distance FROM v a, v b
  WHERE a.vec_id % 100 = 0 AND (a.vec_id % 300 <> 0 OR a.grp = b.grp)),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM vd)
"""


@query("WITH " + _VECTORS + "SELECT query_id, chunk_id, round(distance, 6) AS distance, rank::INTEGER AS rank FROM vr WHERE rank <= 100")
def vector_search(spark, sf):
    found = search.vector_search(S.vector_queries(spark, sf), S.vectors(spark, sf))
    return found.select("query_id", "chunk_id", _sixth("distance").alias("distance"), "rank")


@query("WITH " + _VECTORS + "SELECT query_id, chunk_id, round(distance, 6) AS distance, rank::INTEGER AS rank FROM vr WHERE rank <= 100")
def cluster_search(spark, sf):
    """The nearest vectors again, from stored clusters."""
    path = f"{shared_folder(spark)}/leafquire-stage-clusters-{uuid.uuid4().hex}"
    clusters.write_clusters(S.vectors(spark, sf), kept(path))
    found = clusters.search(S.vector_queries(spark, sf), clusters.read_clusters(spark, path))
    return found.select("query_id", "chunk_id", _sixth("distance").alias("distance"), "rank")


_FUSION = """,
k100 AS (SELECT * FROM kw WHERE rank <= 100), v100 AS (SELECT * FROM vr WHERE rank <= 100),
fu AS (
  SELECT coalesce(k.query_id, v.query_id) AS query_id, coalesce(k.chunk_id, v.chunk_id) AS chunk_id, k.rank AS kr, v.rank AS vr,
    coalesce(2.0 / (60 + k.rank), 0) + coalesce(1.0 / (60 + v.rank), 0) AS score
  FROM k100 k FULL JOIN v100 v ON k.query_id = v.query_id AND k.chunk_id = v.chunk_id),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kr NULLS LAST, vr NULLS LAST) AS fused_rank FROM fu)
"""
_SECTIONS = """,
kn AS (SELECT fr.*, 's' || (doc_id // 100) AS section_id FROM fr JOIN documents ON chunk_id = doc_id::VARCHAR),
be AS (SELECT * FROM kn QUALIFY row_number() OVER (PARTITION BY query_id, section_id ORDER BY fused_rank) = 1),
res AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS rank FROM be)
"""
_FUSED = _KEYWORD + "," + _VECTORS + _FUSION
_BEST = _FUSED + _SECTIONS


def _fused(spark, sf):
    return search.fuse(_keyword(spark, sf), search.vector_search(S.vector_queries(spark, sf), S.vectors(spark, sf)))


def _results(spark, sf):
    return search.best_sections(_fused(spark, sf), S.chunks(spark, sf))


@query(_FUSED + "SELECT query_id, chunk_id, round(score, 6) AS score, fused_rank::INTEGER AS fused_rank FROM fr")
def rank_fusion(spark, sf):
    return _fused(spark, sf).select("query_id", "chunk_id", _sixth("score").alias("score"), "fused_rank")


@query(_BEST + "SELECT query_id, rank::INTEGER AS rank, section_id, chunk_id AS matched_chunk_id, round(score, 6) AS score FROM res WHERE rank <= 5")
def section_results(spark, sf):
    return _results(spark, sf).withColumn("score", _sixth("score"))


_TEXTS = """, t AS (
  SELECT 's' || (doc_id // 100) AS section_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY doc_id::VARCHAR) AS t, count(*) AS n FROM documents GROUP BY ALL),
s AS (SELECT DISTINCT 's' || (doc_id // 100) AS section_id, (doc_id // 100)::INTEGER AS n FROM documents),
ex AS (
  SELECT query_id, rank, section_id, 'Section ' || s.n AS title, 'All > Section ' || s.n AS path,
    CASE WHEN s.n % 7 = 0 THEN '머리말' WHEN s.n % 3 = 0 THEN 'p' || s.n ELSE 'p' || s.n || '~' || (s.n + s.n % 3) END AS citation, t, t.n AS n_chunks
  FROM res JOIN t USING (section_id) JOIN s USING (section_id) WHERE rank <= 5)
"""


@query(_BEST + _TEXTS + "SELECT query_id, rank::INTEGER AS rank, section_id, title, path, citation, md5(t) AS text_md5, n_chunks FROM ex")
def section_expansion(spark, sf):
    out = search.expand(staged(_results(spark, sf)), S.sections(spark, sf), S.chunks(spark, sf))
    return out.select("query_id", "rank", "section_id", "title", F.array_join("level_path", " > ").alias("path"), "citation", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.size("chunk_ids").cast("long").alias("n_chunks"))


_HYBRID = _KEYWORD + """,
v AS (SELECT vec_id::VARCHAR AS id, vec_id, 'g' || label AS grp, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS e FROM embeddings),
vd AS (
  SELECT q.query_id, b.id AS chunk_id, list_distance(a.e, b.e) AS distance FROM q JOIN v a ON a.vec_id % 100 = 0 AND (a.vec_id // 100)::VARCHAR = q.query_id, v b
  WHERE (want_doc IS NULL OR want_doc = b.grp) AND (want_type IS NULL OR want_type = 'text')),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM vd)
""" + _FUSION + _SECTIONS + ", ko AS (SELECT query_id, query_id::INTEGER NOT IN (SELECT vec_id // 100 FROM embeddings WHERE vec_id % 100 = 0) AS keyword_only FROM q)"


@query(_HYBRID + "SELECT query_id, rank::INTEGER AS rank, section_id, chunk_id AS matched_chunk_id, round(score, 6) AS score, keyword_only FROM res JOIN ko USING (query_id) WHERE rank <= 5")
def hybrid_results(spark, sf):
    """Hybrid search; a passage without a vector is answered by keywords alone, and says so."""
    found = search.hybrid_search(S.hybrid_queries(spark, sf), S.chunks(spark, sf), None, None, S.vectors(spark, sf))
    return found.withColumn("score", _sixth("score"))


@query(_HYBRID + _TEXTS + r"""
SELECT query_id, md5(CASE WHEN keyword_only THEN '(keyword search only)' || chr(10) ELSE '' END || string_agg(
    path || chr(10) || '(d, ' || citation || ')' || chr(10) || '[' || section_id || ']' || chr(10)
    || CASE WHEN length(t) > 1200 THEN regexp_replace(substr(t, 1, 1200), '\s+$', '') ELSE t END, chr(10) || '---' || chr(10) ORDER BY rank)) AS text_md5
FROM ex JOIN ko USING (query_id) GROUP BY query_id, keyword_only""")
def result_texts(spark, sf):
    """What is shown for each query: the answer's sections with path, source and snippet."""
    tables = {"chunks": S.chunks(spark, sf), "sections": S.sections(spark, sf)}
    shown = context.result_text(jobs.answer(S.hybrid_queries(spark, sf), tables, S.vectors(spark, sf)))
    return shown.select("query_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(_BEST + """SELECT (query_id::INTEGER // 7)::VARCHAR AS run_id, query_id AS subquery_no, section_id,
  row_number() OVER (PARTITION BY query_id::INTEGER // 7 ORDER BY rank, query_id)::INTEGER AS place FROM res WHERE rank <= 5""")
def interleaved_results(spark, sf):
    """Seven passages are the sub-queries of a run."""
    results = _results(spark, sf).withColumn("run_id", F.floor(F.col("query_id").cast("int") / 7).cast("string")).withColumn("subquery_no", F.col("query_id"))
    return search.interleave(results).select("run_id", "subquery_no", "section_id", "place")


@query(r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) AS key_length, md5(regexp_replace(t, '\s+', '', 'g')) AS squashed,
  md5(regexp_replace(t, '[\s|\-]+', '', 'g')) AS covered, md5(regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS cleaned,
  length(t) > 1200 AS cut, md5(CASE WHEN length(t) > 1200 THEN regexp_replace(substr(t, 1, 1200), '\s+$', '') ELSE t END) AS snippet,
  round_even(length(t) / 0.85::DOUBLE, 0)::BIGINT AS tokens
FROM t""")
def text_functions(spark, sf):
    t = F.coalesce("text", F.lit(""))
    md5 = lambda c: F.md5(c.cast("binary"))
    short = X.truncate(t)
    return S.table(spark, sf, "documents").select(
        "doc_id", F.length(X.match_key(t)).cast("long").alias("key_length"), md5(X.squash(t)).alias("squashed"), md5(X.squash_cover(t)).alias("covered"),
        md5(X.clean_cell(t)).alias("cleaned"), short["cut"].alias("cut"), md5(short["text"]).alias("snippet"), X.tokens(t).alias("tokens"),
    )


_CITED = """
WITH t AS (SELECT l_orderkey::VARCHAR AS chunk_id, l_linenumber AS n, l_partkey AS p, l_suppkey AS s FROM lineitem),
c AS (
  SELECT chunk_id, 0 AS o, n, p, CASE WHEN n % 2 = 0 THEN '국가연구개발혁신법' ELSE '국가연구개발혁신법 시행령' END AS law, '제' || (p % 60 + 1) || '조제' || n || '항' AS target,
    CASE WHEN n % 2 = 0 THEN '혁신법 ' ELSE '시행령 ' END || '제' || (p % 60 + 1) || '조제' || n || '항' AS raw FROM t WHERE p % 7 <> 0
  UNION ALL SELECT chunk_id, 1, n, p, '', '별표' || (s % 9), '별표 ' || (s % 9) FROM t),
refs AS (SELECT chunk_id, 'orders' AS doc_id, law, target, raw FROM c QUALIFY row_number() OVER (PARTITION BY chunk_id, law, target ORDER BY o, n, p) = 1)
"""


@query(_CITED + "SELECT * FROM refs")
def citations_extracted(spark, sf):
    aliases = F.create_map(*[F.lit(x) for kv in P.ALIASES.items() for x in kv])
    return citations.extract(S.cited_chunks(spark, sf), aliases)


@query(_CITED + """, a AS (SELECT DISTINCT law || '|' || target AS ask_id, target, law AS want FROM refs UNION ALL SELECT DISTINCT '*|' || target, target, NULL FROM refs),
hit AS (SELECT DISTINCT ask_id, chunk_id FROM refs JOIN a USING (target) WHERE want IS NULL OR want = law),
r AS (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY chunk_id) AS rank, count(*) OVER (PARTITION BY ask_id) AS n_total FROM hit)
SELECT ask_id, chunk_id, n_total, rank::INTEGER AS rank FROM r WHERE rank <= 5""")
def citation_lookup(spark, sf):
    """Every citation of the orders is looked up, with its law and under any law."""
    refs = staged(citations_extracted(spark, sf))
    asked = refs.select(F.concat_ws("|", "law", "target").alias("ask_id"), "target", "law").unionByName(refs.select(F.concat(F.lit("*|"), "target").alias("ask_id"), "target", F.lit(None).cast("string").alias("law"))).distinct()
    chunks = S.cited_chunks(spark, sf).withColumn("section_id", F.lit("s")).withColumn("page_printed_start", F.lit(1))
    sections = spark.createDataFrame([("s", "t")], "section_id string, title string")
    return citations.lookup(asked, refs, chunks, sections).select("ask_id", "chunk_id", "n_total", "rank")


def _sized_sections(spark, sf):
    sized = S.chunks(spark, sf).select("section_id", "chunk_id", F.length("text").alias("chars"))
    return sized.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "chars"))).alias("x"))


_SIZED = """s AS (SELECT 's' || (doc_id // 100) AS section_id, list(length(coalesce(text, '')) ORDER BY doc_id::VARCHAR) AS c FROM documents GROUP BY ALL)"""


@query("WITH RECURSIVE " + _SIZED + """,
m AS (SELECT section_id, c, len(c) AS n, len(c) // 2 AS mid FROM s),
w(section_id, c, n, lo, hi, total, stop) AS (
  SELECT section_id, c, n, mid, mid, c[mid + 1]::BIGINT, false FROM m
  UNION ALL
  SELECT section_id, c, n, CASE WHEN down THEN lo - 1 ELSE lo END, hi2, total2 + CASE WHEN down THEN c[lo] ELSE 0 END, NOT (up OR down)
  FROM (
    SELECT *, lo > 0 AND total2 + c[lo] <= 2500 AS down FROM (
      SELECT *, CASE WHEN up THEN hi + 1 ELSE hi END AS hi2, total + CASE WHEN up THEN c[hi + 2] ELSE 0 END AS total2 FROM (
        SELECT *, hi + 1 < n AND total + c[hi + 2] <= 2500 AS up FROM w WHERE NOT stop))))
SELECT section_id, lo::INTEGER AS lo, hi::INTEGER AS hi, lo > 0 OR hi < n - 1 AS partial FROM w WHERE stop""")
def evidence_windows(spark, sf):
    sized = _sized_sections(spark, sf)
    sizes = F.transform("x", lambda c: c["chars"])
    return sized.select("section_id", context.evidence_window(sizes, F.floor(F.size("x") / 2)).alias("w")).select("section_id", "w.*")


@query("WITH " + _SIZED + """,
e AS (SELECT section_id, unnest(c) AS chars, unnest(generate_series(0, len(c) - 1)) AS i, len(c) - 1 AS final, (len(c) // 3) AS start FROM s),
r AS (SELECT *, sum(chars) OVER (PARTITION BY section_id ORDER BY i) AS total FROM e WHERE i >= start)
SELECT section_id, start::INTEGER AS "offset", count(*) AS n_chunks, CASE WHEN max(i) < any_value(final) THEN (max(i) + 1)::INTEGER END AS next_offset FROM r WHERE total <= 6000 OR i = start GROUP BY section_id, start""")
def section_pages(spark, sf):
    sized = _sized_sections(spark, sf)
    chunks = sized.select("section_id", F.posexplode("x").alias("at", "c")).select("section_id", "at", F.col("c.chars").alias("chars"))
    return context.page_section(chunks, sized.select("section_id", F.floor(F.size("x") / 3).cast("int").alias("offset")))


_RUNS = r"""
o AS (SELECT conv_id, turn, min({'role': role, 'text': text}) AS x FROM conversations GROUP BY ALL),
w AS (SELECT conv_id, turn, x.role AS role, length(coalesce(x.text, '')) AS size, list_filter(list_transform(regexp_split_to_array(coalesce(x.text, ''), '\s+'), lambda y: translate(y, '[]', '')), lambda y: y <> '') AS ws FROM o),
r AS (
  SELECT a.conv_id::VARCHAR AS run_id, a.turn, a.ws AS cited, u.ws AS got, u.size AS i, a.size AS o
  FROM w a JOIN w u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant' AND u.role = 'user')
"""


@query("WITH " + _RUNS + """, z AS (SELECT *, list_filter(cited, lambda c: NOT list_contains(got, c)) AS bad FROM r)
SELECT run_id, turn, array_to_string(bad, ' ') AS invented, CASE WHEN len(bad) > 0 THEN 'insufficient' ELSE 'sufficient' END AS verdict,
  CASE WHEN len(bad) = 0 THEN 'done' WHEN turn % 2 = 1 OR turn >= 4 THEN 'escalate' ELSE 'retrieve' END AS step FROM z""")
def invented_citations(spark, sf):
    checked = context.check_citations(S.runs(spark, sf))
    simple = F.when(F.col("turn") % 2 == 1, "simple").otherwise("complex")
    return checked.select("run_id", "turn", F.array_join("invented", " ").alias("invented"), "verdict", context.next_step(F.col("verdict"), simple, F.col("turn"), 4).alias("step"))


@query("WITH " + _RUNS + "SELECT run_id, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, count(*) AS calls FROM r GROUP BY run_id")
def run_usage(spark, sf):
    return context.usage(S.runs(spark, sf))


@query(_BEST + """, t AS (SELECT (query_id::INTEGER // 8)::VARCHAR AS run_id, section_id, rank, query_id::INTEGER % 8 AS sub FROM res WHERE rank <= 5),
x AS (SELECT run_id, section_id, CASE WHEN sub % 2 = 0 THEN 0 ELSE 1 END AS age, sub * 10 + rank AS place FROM t),
once AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY run_id, section_id ORDER BY age, place) = 1)
SELECT run_id, section_id, merged_place::INTEGER AS merged_place FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY age, place) AS merged_place FROM once) WHERE merged_place <= 6""")
def merged_evidence(spark, sf):
    """Eight passages are a run's searches; those with an even number are new."""
    q = F.col("query_id").cast("int")
    rows = staged(_results(spark, sf).select(F.floor(q / 8).cast("string").alias("run_id"), "section_id", (q % 8).alias("sub"), (q % 8 * 10 + F.col("rank")).alias("place")))
    return context.merge_evidence(rows.where("sub % 2 = 1").drop("sub"), rows.where("sub % 2 = 0").drop("sub")).select("run_id", "section_id", "merged_place")


@query("SELECT source AS doc_id, lang AS content_type, count(*) AS n_chunks, count(DISTINCT doc_id // 100) AS n_sections FROM documents GROUP BY ROLLUP (source, lang)")
def build_summary(spark, sf):
    return checks.summary(S.chunks(spark, sf))


@query("""SELECT 'documents' AS table_name, count(*) AS n_rows FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'embeddings', count(*) FROM embeddings
UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'benchmark', count(*) FROM benchmark""")
def row_counts(spark, sf):
    return checks.row_counts({n: S.table(spark, sf, n) for n in ("documents", "pages", "embeddings", "labels", "benchmark")})


_REPORT = """r AS (SELECT *, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM x)
SELECT any_value(n) AS n, min(v)::BIGINT AS least, (max(v) FILTER (i = (n - 1) // 2) + max(v) FILTER (i = n // 2)) / 2 AS median,
  max(v) FILTER (i = least(floor(n * 0.9::DOUBLE), n - 1))::BIGINT AS p90, max(v)::BIGINT AS most, count(*) FILTER (v < 50) AS under_50 FROM r"""


@query("WITH x AS (SELECT coalesce(length(text), 0)::BIGINT AS v FROM documents), " + _REPORT)
def chunk_sizes(spark, sf):
    return checks.size_report(S.table(spark, sf, "documents").select(F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size")))


@query("WITH x AS (SELECT sum(coalesce(length(text), 0))::BIGINT AS v FROM documents GROUP BY doc_id // 100), " + _REPORT)
def section_size_report(spark, sf):
    return checks.size_report(checks.section_sizes(S.chunks(spark, sf).withColumn("char_count", F.coalesce("char_count", F.lit(0)))))


def benchmark_cases(spark, sf):
    """Benchmark passages as questions, dealt over all sections; the second answer of some is past the last section and so unknown."""
    last = S.table(spark, sf, "documents").agg(F.floor(F.max("doc_id") / 100)).first()[0] or 0
    b = S.table(spark, sf, "benchmark")
    i = F.col("item_id")
    return b.select(
        i.cast("string").alias("id"), F.when(i % 2 == 0, "even").otherwise("odd").alias("type"),
        F.array(F.concat(F.lit("s"), (i * 7919 % F.lit(last + 1)).cast("string")), F.concat(F.lit("s"), (i * 104729 % F.lit(last + 3)).cast("string"))).alias("answer_sections"), F.array(F.col("text"), F.lit("the")).alias("must_contain"),
    )


CASES = """
WITH c AS (SELECT item_id AS i, item_id::VARCHAR AS id, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS type, text FROM benchmark),
ns AS (SELECT max(doc_id) // 100 AS last FROM documents),
an AS (SELECT i, id, type, 0 AS n, 's' || (i * 7919 % (last + 1)) AS section_id FROM c, ns UNION ALL SELECT i, id, type, 1, 's' || (i * 104729 % (last + 3)) FROM c, ns),
tx AS (SELECT 's' || (doc_id // 100) AS section_id, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id::VARCHAR) AS t FROM documents GROUP BY ALL),
jo AS (SELECT id, string_agg(t, chr(10) ORDER BY n) AS t FROM an JOIN tx USING (section_id) GROUP BY id),
ne AS (SELECT id, type, text AS needle FROM c UNION ALL SELECT id, type, 'the' FROM c),
pr AS (
  SELECT id, type, 'no such section' AS problem, section_id AS detail FROM an WHERE section_id NOT IN (SELECT section_id FROM tx)
  UNION ALL SELECT ne.id, type, 'missing text', needle FROM ne LEFT JOIN jo USING (id) WHERE NOT coalesce(contains(t, needle), false))
"""


@query(CASES + "SELECT id, type, problem, md5(detail) AS detail FROM pr")
def ground_truth_problems(spark, sf):
    found = checks.ground_truth_problems(benchmark_cases(spark, sf), S.sections(spark, sf), S.chunks(spark, sf))
    return found.withColumn("detail", F.md5(F.col("detail").cast("binary")))


@query(CASES + "SELECT type, count(DISTINCT id) AS n_cases, (SELECT count(*) FROM pr WHERE pr.type = c.type) AS n_problems FROM c GROUP BY type")
def ground_truth_types(spark, sf):
    cases = benchmark_cases(spark, sf)
    return checks.cases_by_type(cases, checks.ground_truth_problems(cases, S.sections(spark, sf), S.chunks(spark, sf)))


@query("""SELECT 'chunk' AS kind, doc_id::VARCHAR AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT 'ref', p_partkey::VARCHAR FROM part WHERE p_partkey NOT IN (SELECT doc_id FROM documents)""")
def dangling_rows(spark, sf):
    """Documents as chunks of the vector with their number, parts as citations of the document with theirs."""
    as_string = lambda name, c, to: S.table(spark, sf, name).select(F.col(c).cast("string").alias(to))
    chunks = as_string("documents", "doc_id", "chunk_id").withColumn("section_id", F.col("chunk_id"))
    return checks.dangling(chunks, as_string("embeddings", "vec_id", "section_id"), as_string("part", "p_partkey", "chunk_id"))


@query("""SELECT coalesce(d.doc_id, e.vec_id)::VARCHAR AS chunk_id, CASE WHEN e.vec_id IS NULL THEN 'no vector' ELSE 'no chunk' END AS problem
FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id WHERE d.doc_id IS NULL OR e.vec_id IS NULL""")
def misaligned_vectors(spark, sf):
    return checks.misaligned(S.chunks(spark, sf), S.vectors(spark, sf))
