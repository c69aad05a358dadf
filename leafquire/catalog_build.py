"""Layout, build, forms and index jobs as registered queries; each reads whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafquire.catalog_search import CASES, benchmark_cases, keyword_sql
from leafquire.functions import patterns as P
from leafquire.functions import text as X
from leafquire.operators import blocks, checks, forms, keyword, layout
from leafquire.plans import jobs
from leafquire.registry import query
from leafquire.sources import samples as S
from leafquire.sources import tables
from leafquire.sources.stage import shared_folder, staged
from leafquire.sources.store import Store


def _md5(c):
    return F.md5(F.col(c).cast("binary"))


def _new_path(spark) -> str:
    return f"{shared_folder(spark)}/leafquire-table-{uuid.uuid4().hex}"


_LINES = r"""
l AS (
  SELECT doc_id, i - 1 AS line_no, ls[i] AS text, 1 + (i - 1) // 8 AS page_pdf, 40.0 + 110 * ((i - 1) % 8) AS y0, length(ls[i]) BETWEEN 1 AND 40 AS bold
  FROM (SELECT doc_id::VARCHAR AS doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
body AS (SELECT * FROM l WHERE y0 >= 60 AND y0 <= 782 AND regexp_matches(text, '\S')),
h AS (SELECT doc_id, line_no AS ord, text AS title, 1 + length(text) % 4 AS level, page_pdf, y0 FROM l WHERE bold AND y0 BETWEEN 60 AND 782 AND trim(text) <> ''),
ho AS (SELECT *, row_number() OVER w AS place, coalesce(lead(page_pdf) OVER w, NULL) AS next_page, lead(y0) OVER w AS next_y FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY page_pdf, y0, ord)),
pc AS (SELECT doc_id, max(page_pdf) AS page_count FROM l GROUP BY doc_id)
"""


@query("WITH " + _LINES + "SELECT doc_id, page_pdf::INTEGER AS page_pdf, count(*) AS n, sum(length(text))::BIGINT AS chars FROM body GROUP BY ALL")
def body_lines(spark, sf):
    return layout.body_lines(S.lines(spark, sf)).groupBy("doc_id", "page_pdf").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


_FEET = _LINES + """,
ft AS (SELECT DISTINCT doc_id, page_pdf, page_pdf - doc_id::BIGINT % 3 + CASE WHEN page_pdf % 7 = 0 THEN 1 ELSE 0 END AS n FROM l)
"""


@query("WITH " + _FEET + r"""SELECT doc_id, count(*) AS n FROM (
  SELECT doc_id FROM l WHERE y0 > 0.92 * 842 AND regexp_matches(text, '\S') UNION ALL SELECT doc_id FROM ft WHERE n >= 0) GROUP BY doc_id""")
def footer_lines(spark, sf):
    return layout.footer_lines(S.numbered_lines(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("WITH " + _FEET + r"""
, x AS (SELECT doc_id, page_pdf, regexp_extract(trim(text), '^[/\\]?\s*(\d{1,3})\s*[/\\]?$', 1) AS n FROM l WHERE y0 > 0.92 * 842 AND regexp_matches(text, '\S')
  UNION ALL SELECT doc_id, page_pdf, n::VARCHAR FROM ft WHERE n BETWEEN 0 AND 999)
SELECT doc_id, count(*) FILTER (n::INTEGER = page_pdf - doc_id::BIGINT % 3) AS n_equal, count(*) FILTER (n::INTEGER <> page_pdf - doc_id::BIGINT % 3) AS n_other FROM x WHERE n <> '' GROUP BY doc_id""")
def page_numbers(spark, sf):
    return checks.page_numbers(S.numbered_lines(spark, sf), S.profiles(spark, sf))


@query("WITH " + _LINES + r"""
SELECT doc_id, line_no::INTEGER AS line_no, bold AS typeset,
  row_number() OVER (PARTITION BY doc_id, page_pdf ORDER BY round_even(40.0 + 110 * ((line_no % 8) // 2) + 0.02 * (line_no % 2), 1), CASE WHEN line_no % 2 = 0 THEN 300 ELSE 72 END, line_no)::INTEGER AS place FROM l""")
def reading_order(spark, sf):
    """Lines of two columns in reading order, and whether they are typeset."""
    place = F.row_number().over(layout.reading_order("doc_id", "page_pdf"))
    return layout.typeset(S.two_columns(spark, sf), S.profiles(spark, sf)).select("doc_id", "line_no", "typeset", place.alias("place"))


@query("WITH RECURSIVE " + _LINES + """,
st(doc_id, place, lv, ti) AS (
  SELECT doc_id, place, [level], [title] FROM ho WHERE place = 1
  UNION ALL
  SELECT ho.doc_id, ho.place, list_append(list_filter(lv, lambda x: x < ho.level), ho.level),
    list_append(list_transform(list_filter(generate_series(1, len(lv)), lambda i: lv[i] < ho.level), lambda i: ti[i]), ho.title)
  FROM st JOIN ho ON ho.doc_id = st.doc_id AND ho.place = st.place + 1)
SELECT doc_id, ho.ord::INTEGER AS ord, array_to_string(ti, ' > ') AS path FROM st JOIN ho USING (doc_id, place)""")
def level_paths(spark, sf):
    return layout.level_paths(S.headings(spark, sf)).select("doc_id", "ord", F.array_join("level_path", " > ").alias("path"))


@query("WITH " + _LINES + """,
k AS (SELECT ho.*, coalesce(next_page, page_count) AS end_page, (page_pdf - doc_id::BIGINT % 3) NOT BETWEEN 6 AND 7 AS kept FROM ho JOIN pc USING (doc_id))
SELECT doc_id, ord::INTEGER AS ord, page_pdf::INTEGER AS page_pdf, end_page::INTEGER AS end_page,
  CASE WHEN kept THEN format('{}-s{:03d}', doc_id, (sum(kept::INTEGER) OVER (PARTITION BY doc_id ORDER BY place))::BIGINT - 1) END AS section_id,
  CASE WHEN page_pdf - doc_id::BIGINT % 3 >= 1 THEN (page_pdf - doc_id::BIGINT % 3)::INTEGER END AS printed
FROM k""")
def section_spans(spark, sf):
    spans = layout.section_spans(S.headings(spark, sf), S.profiles(spark, sf)).join(S.profiles(spark, sf).select("doc_id", "page_offset"), "doc_id")
    return spans.select("doc_id", "ord", "page_pdf", "end_page", "section_id", X.printed_page(F.col("page_pdf"), F.col("page_offset")).alias("printed"))


_ASSIGNED = "WITH " + _LINES + """,
bk AS (SELECT *, page_pdf * 100000 + y0 AS k FROM body), hk AS (SELECT *, page_pdf * 100000 + y0 AS k FROM ho),
asg AS (
  SELECT b.doc_id, b.line_no, b.page_pdf, b.text, b.y0, coalesce(hk.place, 0) AS place
  FROM bk b ASOF LEFT JOIN hk ON b.doc_id = hk.doc_id AND b.k >= hk.k
  LEFT JOIN ho nx ON nx.doc_id = b.doc_id AND nx.place = coalesce(hk.place, 0) + 1
  WHERE (hk.place IS NULL OR hk.page_pdf < b.page_pdf OR b.y0 >= hk.y0 + 1) AND (nx.place IS NULL OR nx.page_pdf > b.page_pdf OR b.y0 <= nx.y0 - 1))
"""


@query(_ASSIGNED + "SELECT doc_id, line_no::INTEGER AS line_no, place::INTEGER AS place FROM asg")
def lines_to_sections(spark, sf):
    spans = layout.section_spans(S.headings(spark, sf), S.profiles(spark, sf))
    body = layout.body_lines(S.lines(spark, sf)).select("doc_id", "page_pdf", "line_no", "y0")  # what is dealt by range is written
    return layout.assign(body, spans).select("doc_id", "line_no", "place")


@query(_ASSIGNED.replace("WITH", "WITH RECURSIVE", 1) + r""",
z AS (SELECT doc_id, place, line_no, page_pdf, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, row_number() OVER (PARTITION BY doc_id, place ORDER BY line_no) AS i FROM asg),
g(doc_id, place, i, total, run) AS (
  SELECT doc_id, place, i, length(t), 0 FROM z WHERE i = 1
  UNION ALL
  SELECT z.doc_id, z.place, z.i, CASE WHEN total + length(t) > 700 THEN length(t) ELSE total + length(t) END, CASE WHEN total + length(t) > 700 THEN run + 1 ELSE run END
  FROM g JOIN z ON z.doc_id = g.doc_id AND z.place = g.place AND z.i = g.i + 1)
SELECT doc_id, place::INTEGER AS place, run::INTEGER AS run, md5(string_agg(t, chr(10) ORDER BY i)) AS text_md5, min(page_pdf)::INTEGER AS page_start, max(page_pdf)::INTEGER AS page_end
FROM g JOIN z USING (doc_id, place, i) GROUP BY doc_id, place, run""")
def packed_chunks(spark, sf):
    spans = layout.section_spans(S.headings(spark, sf), S.profiles(spark, sf))
    rows = layout.assign(layout.body_lines(S.lines(spark, sf)), spans)
    out = blocks.pack_lines(rows, ["doc_id", "place"], ["line_no"])
    return out.select("doc_id", "place", "run", F.md5(F.col("text").cast("binary")).alias("text_md5"), "page_start", "page_end")


_CONTENTS = """
WITH l AS (SELECT 'p' || (p_partkey // 100) AS doc_id, p_partkey AS k, p_name, p_size,
  CASE WHEN p_partkey % 20 = 0 THEN '제' || p_partkey || '장 ' || p_name WHEN p_partkey % 20 = 1 THEN p_name ELSE p_partkey || '. ' || p_name END AS head FROM part),
e AS (
  SELECT doc_id, k, 0 AS j, head || CASE WHEN k % 3 = 0 THEN ' more' ELSE '' END AS title, p_size AS page, CASE WHEN k % 20 < 2 THEN 1 ELSE 2 END AS level, k % 20 <> 1 AS numbered FROM l
  UNION ALL SELECT doc_id, k, 1, '[표 ' || k || '] x', 7, 0, true FROM l WHERE k % 4 = 0 AND k % 3 <> 0)
"""


@query(_CONTENTS + """SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1)::INTEGER AS ord, title, level, page::INTEGER AS page_printed, numbered,
  CASE WHEN j = 1 THEN 'caption' ELSE 'section' END AS kind FROM e""")
def contents_entries(spark, sf):
    return layout.contents_entries(*S.contents(spark, sf))


_NUMBER = P.LEADING_NUMBER.replace("(?U)", "")


@query(_CONTENTS + f"""SELECT doc_id, title, regexp_replace(title, '{_NUMBER}', '') AS bare, regexp_replace(regexp_replace(title || ' ···', '\\s+', '', 'g'), '[{P.DOTS}]+$', '') AS plain, count(*) AS n FROM e GROUP BY ALL""")
def title_functions(spark, sf):
    """Contents titles without their number, and without white space and leader dots."""
    entries = layout.contents_entries(*S.contents(spark, sf)).groupBy("doc_id", "title").agg(F.count("*").alias("n"))
    title = F.col("title")
    return entries.select("doc_id", "title", X.strip_number(title).alias("bare"), X.normalize(F.concat(title, F.lit(" ···"))).alias("plain"), "n")


@query()
def pinned_headings(spark, sf):
    """All ways to pin a title; the similar ones have no SQL, a brute force tests them."""
    return layout.pin_headings(*S.titled_pages(spark, sf))


_TITLED = f"""
WITH p AS (
  SELECT page_id::VARCHAR AS doc_id, page_id AS i, coalesce(html, '') AS h, regexp_extract(coalesce(html, ''), '(?s)<title>(.*?)</title>', 1) AS t FROM pages),
en AS (
  SELECT doc_id, CASE WHEN i % 5 = 0 THEN '3. ' ELSE '' END || CASE i % 4 WHEN 0 THEN t WHEN 1 THEN substr(t, 1, 12) WHEN 2 THEN substr(t, 1, 4) || 'qz' || substr(t, 6, 99) ELSE 'zzzz qqqq xxxx' END AS title FROM p),
tk AS (SELECT doc_id, title, list_distinct([regexp_replace(title, '[^\\p{{L}}\\p{{N}}]', '', 'g'), regexp_replace(regexp_replace(title, '{_NUMBER}', ''), '[^\\p{{L}}\\p{{N}}]', '', 'g')]) AS ts FROM en),
tg AS (SELECT doc_id, title, CASE WHEN len(list_filter(ts, lambda x: length(x) >= 4)) > 0 THEN list_filter(ts, lambda x: length(x) >= 4) ELSE list_filter(ts, lambda x: x <> '') END AS ts FROM tk),
ln AS (
  SELECT doc_id, unnest(generate_series(0, len(tags) - 1)) AS line_no, unnest(tags) AS tag, unnest(texts) AS text
  FROM (SELECT doc_id, regexp_extract_all(h, '<(/?[a-zA-Z][a-zA-Z0-9]*)[^<>]*>([^<>]*)', 1) AS tags, regexp_extract_all(h, '<(/?[a-zA-Z][a-zA-Z0-9]*)[^<>]*>([^<>]*)', 2) AS texts FROM p)),
bl AS (
  SELECT doc_id, line_no, 1 + line_no // 20 AS page, regexp_matches(tag, '^(h[1-6]|b)$') AS typeset, regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS key,
    row_number() OVER (PARTITION BY doc_id, line_no // 20 ORDER BY line_no) AS n FROM ln WHERE regexp_matches(text, '\\S')),
jo AS (
  SELECT a.doc_id, a.page, a.n, a.line_no, k, string_agg(b.key, '' ORDER BY b.n) AS joined
  FROM bl a, (SELECT unnest([1, 2, 3, 4]) AS k) JOIN bl b ON b.doc_id = a.doc_id AND b.page = a.page AND b.n BETWEEN a.n AND a.n + k - 1
  WHERE a.typeset AND a.page <= 4 GROUP BY ALL HAVING count(*) = k),
pr AS (
  SELECT *, lag(joined) OVER (PARTITION BY doc_id, page, n ORDER BY k) AS head FROM jo WHERE joined <> ''),
hi AS (
  SELECT doc_id, title, page, line_no, n, k, joined = target AS exact, 2 * length(target) / (length(joined) + length(target)) AS score
  FROM (SELECT pr.*, title, ts, unnest(ts) AS target FROM pr JOIN tg USING (doc_id)) WHERE (head IS NULL OR len(list_filter(ts, lambda t: starts_with(t, head))) > 0) AND starts_with(joined, target)),
su AS (SELECT * FROM hi QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page, exact DESC, CASE WHEN exact THEN 0 ELSE score END DESC, n, k) = 1)
"""


@query(_TITLED + "SELECT doc_id, title, page::INTEGER AS page_pdf, 100.0::DOUBLE + 20 * (line_no % 20) AS y0, CASE WHEN exact THEN 'exact' ELSE 'prefix' END AS method FROM su")
def sure_headings(spark, sf):
    """The titles that stand in the page as they are, or begin a line."""
    return pinned_headings(spark, sf).where("method IN ('exact', 'prefix')").select("doc_id", "title", "page_pdf", "y0", "method")


@query(_TITLED + """SELECT tg.doc_id, count(*) FILTER (exact) AS exact, count(*) FILTER (NOT exact) AS prefix, count(*) FILTER (exact IS NULL) AS not_sure FROM tg LEFT JOIN su USING (doc_id) GROUP BY tg.doc_id""")
def heading_methods(spark, sf):
    counts = checks.heading_methods(pinned_headings(spark, sf))
    return counts.select("doc_id", "exact", "prefix", (F.col("fuzzy") + F.col("none")).alias("not_sure"))


_ITEMS = f"i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(S.ITEM)}) AS r FROM lineitem)"


@query(f"""
WITH {_ITEMS},
c AS (
  SELECT l_orderkey AS table_id, r, unnest([0, 1, 2, 3]) AS c,
    unnest([CASE WHEN r % 3 = 0 THEN '' ELSE l_returnflag END, CASE WHEN l_partkey % 2 = 0 THEN '' ELSE l_linestatus END, l_quantity::INTEGER::VARCHAR, r::VARCHAR]) AS v FROM i),
k AS (SELECT * FROM c WHERE NOT (r % 4 = 2 AND c >= 2)),
b AS (SELECT *, CASE WHEN r - lag(r) OVER (PARTITION BY table_id, c ORDER BY r) > 1 THEN 1 ELSE 0 END AS gap FROM k),
g AS (SELECT *, sum(gap) OVER (PARTITION BY table_id, c ORDER BY r) AS run FROM b)
SELECT table_id, r::INTEGER AS r, c::INTEGER AS c, coalesce(last_value(nullif(v, '') IGNORE NULLS) OVER (PARTITION BY table_id, c, run ORDER BY r ROWS UNBOUNDED PRECEDING), '') AS value FROM g""")
def filled_cells(spark, sf):
    return blocks.fill_merged(S.cells(spark, sf))


def _item_tables(spark, sf):
    """Orders as tables of their line items, with gaps."""
    row = F.array(F.when(F.col("r") % 3 == 0, "").otherwise(F.col("l_partkey").cast("string")), F.col("l_returnflag"), F.when(F.col("l_partkey") % 2 == 0, "= x").otherwise(""))
    grouped = S.items(spark, sf).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("r", row.alias("row")))).alias("x"))
    return grouped.select(F.col("l_orderkey").alias("doc_id"), F.transform("x", lambda x: x["row"]).alias("rows"), F.array().cast("array<string>").alias("residual"))


@query(f"""
WITH {_ITEMS},
t AS (SELECT l_orderkey AS doc_id, list([CASE WHEN r % 3 = 0 THEN '' ELSE l_partkey::VARCHAR END, l_returnflag, CASE WHEN l_partkey % 2 = 0 THEN '= x' ELSE '' END] ORDER BY r) AS rows FROM i GROUP BY ALL),
c AS (SELECT *, flatten(rows) AS cs, array_to_string(flatten(rows), ' ') AS j FROM t WHERE len(rows) >= 2),
k AS (
  SELECT *, len(rows) <= 5 AND contains(j, '=') AND length(j) < 400 AS formula, len(list_filter(cs, lambda x: x = '')) / len(cs) AS empty,
    list_max(list_transform(cs, lambda x: length(x))) / list_sum(list_transform(cs, lambda x: length(x))) AS share FROM c)
SELECT doc_id, CASE WHEN formula THEN 'formula' ELSE 'table' END AS kind,
  CASE WHEN formula THEN array_to_string(list_transform(rows, lambda r: r[1]), chr(10))
  ELSE array_to_string(list_concat(['| ' || array_to_string(rows[1], ' | ') || ' |', '|---|---|---|'], list_transform(rows[2:], lambda r: '| ' || array_to_string(r, ' | ') || ' |')), chr(10)) END AS text
FROM k WHERE formula OR (empty <= 0.6 AND share <= 0.5)""")
def table_texts(spark, sf):
    return blocks.table_parts(blocks.gate_tables(_item_tables(spark, sf))).select("doc_id", "kind", "text")


_COVERED = "WITH " + _LINES + r""",
k AS (SELECT doc_id, regexp_replace(text, '[\s|\-]+', '', 'g') AS key FROM body WHERE NOT (doc_id::BIGINT % 2 = 0 AND page_pdf = 1) AND (page_pdf - doc_id::BIGINT % 3) NOT BETWEEN 6 AND 7),
t AS (SELECT doc_id, string_agg(regexp_replace(text, '[\s|\-]+', '', 'g'), chr(10)) AS w FROM l WHERE line_no % 9 <> 5 GROUP BY doc_id)
, cv AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (contains(w, key)) AS n_found, round(count(*) FILTER (contains(w, key)) / count(*), 6) AS share
  FROM k JOIN t USING (doc_id) WHERE length(key) >= 6 GROUP BY doc_id)
"""


@query(_COVERED + "SELECT * FROM cv")
def coverage(spark, sf):
    """Coverage by chunks from which every ninth line was taken, so that something is missing."""
    kept = S.lines(spark, sf).where("line_no % 9 <> 5").select("doc_id", "text")
    none = kept.where("false").select("doc_id", F.col("text").alias("title"))
    out = checks.coverage(S.lines(spark, sf), S.profiles(spark, sf), kept, none)
    return out.withColumn("share", F.round("share", 6))


@query(_COVERED + "SELECT count(*) AS n_docs, min(share) AS least, coalesce(min(share) >= 0.99, true) AS passes FROM cv")
def coverage_verdict(spark, sf):
    return checks.coverage_verdict(coverage(spark, sf))


@query()
def corpus_build(spark, sf):
    """The whole build over documents, with their short lines as contents and every eleventh line as a table.

    Titles are pinned, also similar ones, so it has no SQL; ``built_chunks`` and
    ``built_sections`` check everything after the pins.
    """
    profiles = S.profiles(spark, sf)
    entries = S.headings(spark, sf).join(profiles.select("doc_id", "page_offset"), "doc_id").select(
        "doc_id", "ord", "title", "level", (F.col("page_pdf") - F.col("page_offset")).cast("int").alias("page_printed"), F.lit(True).alias("numbered"), F.lit("section").alias("kind"))
    made = jobs.build(S.lines(spark, sf), profiles, S.raw_tables(spark, sf), entries)
    return made["chunks"].join(made["sections"].select("section_id", "title", F.array_join("level_path", " > ").alias("path")), "section_id")


_STRIP = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_SQUASH = lambda c: rf"regexp_replace({c}, '\s+', '', 'g')"
_BUILT = _ASSIGNED.replace("WITH", "WITH RECURSIVE", 1) + rf""",
tb AS (
  SELECT doc_id, page_pdf, line_no AS table_no, y0 - 80 AS top, y0 + CASE WHEN line_no % 22 = 3 THEN 20 ELSE 130 END AS bottom,
    list_filter(regexp_split_to_array(text, '[ \t\r\f]+'), lambda w: w <> '') AS ws FROM l WHERE line_no % 11 = 3),
tr AS (SELECT *, list_transform(generate_series(0, (len(ws) - 1) // 4), lambda i: ws[4 * i + 1:4 * i + 4]) AS rows, array_to_string(ws, ' ') AS j FROM tb WHERE len(ws) > 4),
gt AS (
  SELECT *, CASE WHEN len(rows) <= 5 AND contains(j, '=') AND length(j) < 400 THEN 'formula' ELSE 'table' END AS kind FROM tr
  WHERE (len(rows) <= 5 AND contains(j, '=') AND length(j) < 400) OR list_max(list_transform(ws, lambda x: length(x))) / list_sum(list_transform(ws, lambda x: length(x))) <= 0.5),
cap AS (
  SELECT g.doc_id, table_no, {_STRIP("b.text")} AS caption FROM gt g JOIN body b ON b.doc_id = g.doc_id AND b.page_pdf = g.page_pdf AND g.top - b.y0 > 0 AND g.top - b.y0 <= 45
  WHERE b.bold AND length({_STRIP("b.text")}) <= 60),
rs AS (
  SELECT g.doc_id, table_no, list({_STRIP("b.text")} ORDER BY b.y0) AS residual FROM gt g JOIN body b ON b.doc_id = g.doc_id AND b.page_pdf = g.page_pdf AND b.y0 BETWEEN top - 2 AND bottom + 2
  WHERE length({_SQUASH("b.text")}) >= 2 AND NOT contains({_SQUASH("j")}, {_SQUASH("b.text")}) AND kind <> 'formula' GROUP BY ALL),
tk AS (SELECT gt.*, coalesce(caption, '') AS caption, coalesce(residual, []) AS residual, (top + bottom) / 2 AS mid, page_pdf * 100000 + (top + bottom) / 2 AS k FROM gt LEFT JOIN cap USING (doc_id, table_no) LEFT JOIN rs USING (doc_id, table_no)),
bx AS (
  SELECT t.*, coalesce(hk.place, 0) AS place
  FROM tk t ASOF LEFT JOIN hk ON t.doc_id = hk.doc_id AND t.k >= hk.k LEFT JOIN ho nx ON nx.doc_id = t.doc_id AND nx.place = coalesce(hk.place, 0) + 1
  WHERE (hk.place IS NULL OR hk.page_pdf < t.page_pdf OR mid >= hk.y0 + 1) AND (nx.place IS NULL OR nx.page_pdf > t.page_pdf OR mid <= nx.y0 - 1)
    AND (hk.place IS NOT NULL OR NOT (t.doc_id::BIGINT % 2 = 0 AND t.page_pdf = 1))),
fl AS (
  SELECT * FROM asg a WHERE (place > 0 OR NOT (doc_id::BIGINT % 2 = 0 AND page_pdf = 1))
    AND NOT EXISTS (SELECT 1 FROM bx WHERE bx.doc_id = a.doc_id AND bx.place = a.place AND bx.page_pdf = a.page_pdf AND a.y0 BETWEEN top - 2 AND bottom + 2)
    AND NOT EXISTS (SELECT 1 FROM bx WHERE bx.doc_id = a.doc_id AND bx.place = a.place AND bx.page_pdf = a.page_pdf AND caption <> '' AND {_SQUASH("caption")} = {_SQUASH("a.text")})),
mk AS (SELECT doc_id, place, page_pdf, y0 AS y, 1 AS is_line, line_no AS n, {_STRIP("text")} AS t FROM fl UNION ALL SELECT doc_id, place, page_pdf, top, 0, table_no, '' FROM bx),
il AS (SELECT *, row_number() OVER w AS o, coalesce(sum(1 - is_line) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM mk WINDOW w AS (PARTITION BY doc_id, place ORDER BY page_pdf, y, is_line, n)),
ic AS (SELECT *, sum(length(t)) OVER i AS chars, min(is_line) OVER i AS open FROM il WINDOW i AS (PARTITION BY doc_id, place, island)),
ld AS (SELECT doc_id, place, island, string_agg(t, chr(10) ORDER BY o) || chr(10) AS lead FROM ic WHERE is_line = 1 AND open = 0 AND chars < 60 GROUP BY ALL),
z AS (SELECT doc_id, place, island, page_pdf, t, row_number() OVER (PARTITION BY doc_id, place, island ORDER BY o) AS i FROM ic WHERE is_line = 1 AND NOT (open = 0 AND chars < 60)),
g(doc_id, place, island, i, total, run) AS (
  SELECT doc_id, place, island, i, length(t), 0 FROM z WHERE i = 1
  UNION ALL
  SELECT z.doc_id, z.place, z.island, z.i, CASE WHEN total + length(t) > 700 THEN length(t) ELSE total + length(t) END, CASE WHEN total + length(t) > 700 THEN run + 1 ELSE run END
  FROM g JOIN z ON z.doc_id = g.doc_id AND z.place = g.place AND z.island = g.island AND z.i = g.i + 1),
tx AS (SELECT doc_id, place, island, 0 AS kind, run, 'text' AS content_type, string_agg(t, chr(10) ORDER BY i) AS text, min(page_pdf) AS ps, max(page_pdf) AS pe, '' AS caption FROM g JOIN z USING (doc_id, place, island, i) GROUP BY ALL),
tm AS (
  SELECT bx.*, ic.island, coalesce(lead, '') AS lead, list_max(list_transform(rows, lambda r: len(r))) AS width
  FROM bx JOIN ic ON ic.is_line = 0 AND ic.doc_id = bx.doc_id AND ic.place = bx.place AND ic.n = bx.table_no LEFT JOIN ld ON ld.doc_id = bx.doc_id AND ld.place = bx.place AND ld.island = ic.island),
tl AS (SELECT *, list_transform(rows, lambda r: '| ' || array_to_string(list_concat(r, list_resize([]::VARCHAR[], width - len(r), '')), ' | ') || ' |') AS rl FROM tm),
tw AS (
  SELECT *, rl[1] || chr(10) || '|' || repeat('---|', width) AS head,
    CASE WHEN kind = 'formula' THEN array_to_string(list_transform(rows, lambda r: r[1]), chr(10))
    ELSE array_to_string(list_concat([rl[1], '|' || repeat('---|', width)], rl[2:], CASE WHEN len(residual) > 0 THEN list_concat([''], residual) ELSE [] END), chr(10)) END AS whole FROM tl),
tp AS (SELECT doc_id, table_no, unnest(rl[2:]) AS r, unnest(generate_series(1, len(rl) - 1)) AS i FROM tw WHERE kind = 'table' AND length(whole) > 1800),
tg(doc_id, table_no, i, total, run) AS (
  SELECT doc_id, table_no, i, length(r), 0 FROM tp WHERE i = 1
  UNION ALL
  SELECT tp.doc_id, tp.table_no, tp.i, CASE WHEN total + length(r) > 1800 THEN length(r) ELSE total + length(r) END, CASE WHEN total + length(r) > 1800 THEN run + 1 ELSE run END
  FROM tg JOIN tp ON tp.doc_id = tg.doc_id AND tp.table_no = tg.table_no AND tp.i = tg.i + 1),
ts AS (SELECT doc_id, table_no, run, string_agg(r, chr(10) ORDER BY i) AS body FROM tg JOIN tp USING (doc_id, table_no, i) GROUP BY ALL),
tt AS (
  SELECT doc_id, place, island, 1 AS kind, coalesce(run, 0) AS run, kind AS content_type,
    CASE WHEN coalesce(run, 0) = 0 THEN CASE WHEN caption <> '' THEN caption || chr(10) ELSE '' END || lead ELSE '' END || CASE WHEN body IS NULL THEN whole ELSE head || chr(10) || body END AS text, page_pdf AS ps, page_pdf AS pe, caption
  FROM tw LEFT JOIN ts USING (doc_id, table_no)),
al AS (SELECT *, row_number() OVER (PARTITION BY doc_id, place ORDER BY island, kind, run) - 1 AS number FROM (SELECT * FROM tx UNION ALL SELECT * FROM tt)),
fr AS (SELECT doc_id, min(h.page_pdf) AS end_page FROM h WHERE doc_id IN (SELECT doc_id FROM al WHERE place = 0) GROUP BY doc_id),
kp AS (SELECT ho.doc_id, ho.place, ho.title, ho.page_pdf, coalesce(next_page, page_count) AS end_page, (ho.page_pdf - doc_id::BIGINT % 3) NOT BETWEEN 6 AND 7 AS kept FROM ho JOIN pc USING (doc_id)),
sn AS (
  SELECT kp.*, format('{{}}-s{{:03d}}', doc_id, (sum(kept::INTEGER) OVER (PARTITION BY doc_id ORDER BY place))::BIGINT - 1 + (fr.doc_id IS NOT NULL)::INTEGER) AS section_id FROM kp LEFT JOIN fr USING (doc_id)),
st(doc_id, place, lv, ti) AS (
  SELECT doc_id, place, [level], [title] FROM ho WHERE place = 1
  UNION ALL
  SELECT ho.doc_id, ho.place, list_append(list_filter(lv, lambda x: x < ho.level), ho.level),
    list_append(list_transform(list_filter(generate_series(1, len(lv)), lambda i: lv[i] < ho.level), lambda i: ti[i]), ho.title)
  FROM st JOIN ho ON ho.doc_id = st.doc_id AND ho.place = st.place + 1),
se AS (
  SELECT sn.doc_id, sn.place, section_id, title, array_to_string(ti, ' > ') AS path, page_pdf, end_page FROM sn JOIN st USING (doc_id, place) WHERE kept
  UNION ALL SELECT doc_id, 0, doc_id || '-front', '머리말', '머리말', 1, end_page FROM fr),
pg AS (SELECT se.*, doc_id::BIGINT % 3 AS page_offset FROM se)
"""


@query(_BUILT + """SELECT section_id || format('-c{:02d}', number) AS chunk_id, section_id, content_type, md5(text) AS text_md5, md5('[Manual ' || doc_id || '] ' || path || chr(10) || text) AS embedding_md5,
  ps::INTEGER AS page_pdf_start, pe::INTEGER AS page_pdf_end, CASE WHEN ps > page_offset THEN (ps - page_offset)::INTEGER END AS page_printed_start, CASE WHEN pe > page_offset THEN (pe - page_offset)::INTEGER END AS page_printed_end,
  length(text)::INTEGER AS char_count, caption FROM al JOIN pg USING (doc_id, place)""")
def built_chunks(spark, sf):
    """Chunks of the build from given headings: tables with captions and residual lines, lead-ins, packed texts, ids."""
    made = jobs.assemble(S.lines(spark, sf), S.profiles(spark, sf), S.raw_tables(spark, sf), S.headings(spark, sf))["chunks"]
    return made.select("chunk_id", "section_id", "content_type", _md5("text").alias("text_md5"), _md5("text_for_embedding").alias("embedding_md5"), "page_pdf_start", "page_pdf_end", "page_printed_start", "page_printed_end", "char_count", "caption")


@query(_BUILT + """SELECT section_id, doc_id, title, path, page_pdf::INTEGER AS page_pdf_start, end_page::INTEGER AS page_pdf_end,
  CASE WHEN page_pdf > page_offset THEN (page_pdf - page_offset)::INTEGER END AS page_printed_start, CASE WHEN end_page > page_offset THEN (end_page - page_offset)::INTEGER END AS page_printed_end FROM pg""")
def built_sections(spark, sf):
    """Sections of the build from given headings, front matter included."""
    made = jobs.assemble(S.lines(spark, sf), S.profiles(spark, sf), S.raw_tables(spark, sf), S.headings(spark, sf))["sections"]
    return made.withColumn("path", F.array_join("level_path", " > ")).drop("level_path")


_FORMS = """
WITH fa AS (SELECT 'p' || (p_partkey // 100) AS doc_id, (p_partkey % 100 >= 50)::INTEGER AS second, (p_partkey % 50)::INTEGER AS j, p_name AS name FROM part),
fd AS (SELECT *, max(second) OVER (PARTITION BY doc_id) AS most, CASE second WHEN 1 THEN '서식 모음' ELSE '서식 모음(50종)' END AS appendix_title FROM fa),
fk AS (SELECT *, 10 + j + 51 * second AS page_start FROM fd WHERE j % 11 <> 7 AND j % 9 <> 4),
fc AS (
  SELECT doc_id, 1 + 2 * second AS appendix_no, appendix_title, CASE j % 3 WHEN 0 THEN '제' || j || '호' WHEN 1 THEN '별표' || j ELSE j || '.' END AS form_no, name, page_start,
    greatest(page_start, coalesce(lead(page_start) OVER (PARTITION BY doc_id, second ORDER BY j) - 1, CASE WHEN second < most THEN 59 ELSE 200 END)) AS page_end,
    row_number() OVER (PARTITION BY doc_id ORDER BY second, j) - 1 AS number FROM fk),
ch AS (
  SELECT doc_id || format('-forms-c{:03d}', number) AS chunk_id, doc_id, 'form_index' AS content_type, name, page_start, page_end,
    '서식명: ' || name || chr(10) || '근거: ' || appendix_title || ' ' || form_no || chr(10) || '수록 위치: 본권 인쇄 p' || page_start || '~' || page_end AS text FROM fc)
"""


@query(_FORMS + "SELECT doc_id, appendix_no::INTEGER AS appendix_no, appendix_title, form_no, name, page_start::INTEGER AS page_start, page_end::INTEGER AS page_end FROM fc")
def form_catalog(spark, sf):
    return forms.catalog(*S.form_pages(spark, sf)).drop("form_order")


@query(_FORMS + """SELECT doc_id, appendix_no::INTEGER AS appendix_no, appendix_title, count(*) AS n_forms, CASE WHEN appendix_no = 1 THEN 50 END AS declared, CASE WHEN appendix_no = 1 THEN count(*) = 50 END AS agrees
FROM fc GROUP BY doc_id, appendix_no, appendix_title""")
def declared_forms(spark, sf):
    return forms.against_declared(forms.catalog(*S.form_pages(spark, sf)))


def _form_chunks(spark, sf):
    lines, profiles = S.form_pages(spark, sf)
    return forms.form_chunks(forms.catalog(lines, profiles), profiles)


@query(_FORMS + """SELECT chunk_id, doc_id || '-forms' AS section_id, text, '[Manual ' || doc_id || '] 서식 목록' || chr(10) || text AS text_for_embedding, page_start::INTEGER AS page_pdf_start, page_end::INTEGER AS page_pdf_end, name AS caption FROM ch""")
def form_chunks(spark, sf):
    return _form_chunks(spark, sf).select("chunk_id", "section_id", "text", "text_for_embedding", "page_pdf_start", "page_pdf_end", "caption")


@query(_FORMS + """SELECT doc_id || '-forms' AS section_id, '서식 목록' AS title, min(page_start)::INTEGER AS page_pdf_start, max(page_end)::INTEGER AS page_pdf_end FROM ch GROUP BY doc_id""")
def form_sections(spark, sf):
    return forms.form_sections(_form_chunks(spark, sf)).select("section_id", "title", "page_pdf_start", "page_pdf_end")


@query(_FORMS.replace("WITH", "WITH RECURSIVE", 1) + "," + keyword_sql("SELECT chunk_id, doc_id, content_type, regexp_extract_all(lower(text), '[0-9A-Za-z가-힣]+') AS ws FROM ch",
       "SELECT DISTINCT p_name AS query_id, p_name AS query, NULL AS want_doc, 'form_index' AS want_type FROM part")
       + "SELECT query_id, kw.chunk_id, rank::INTEGER AS rank, round(score, 6) AS score, name AS caption FROM kw JOIN ch USING (chunk_id) WHERE rank <= 5")
def form_lookup(spark, sf):
    """The best five forms for each part's name."""
    asked = S.table(spark, sf, "part").select(F.col("p_name").alias("query_id"), F.col("p_name").alias("query"), F.lit(None).cast("string").alias("doc_id")).distinct()
    return keyword.find_forms(asked, staged(_form_chunks(spark, sf))).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"), "caption")


@query("""SELECT doc_id::VARCHAR AS chunk_id, source AS doc_id, lang AS content_type, md5(coalesce(text, '')) AS text_md5, (doc_id % 50 + 1)::INTEGER AS page_printed_start, length(text)::INTEGER AS char_count FROM documents""")
def json_chunks(spark, sf):
    """Chunks written as JSON lines and read back by their schema."""
    rows = S.chunks(spark, sf)
    schema = tables.columns("chunks")
    rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    path = _new_path(spark)
    tables.write_json(rows, path)
    return tables.read(spark, "chunks", path, "json").select("chunk_id", "doc_id", "content_type", _md5("text").alias("text_md5"), "page_printed_start", "char_count")


@query("""
WITH s AS (SELECT DISTINCT (doc_id // 100)::INTEGER AS n FROM documents)
SELECT 's' || n AS section_id, '["All","Section ' || n || '"]' AS stored, 'All > Section ' || n AS path, CASE WHEN n % 7 > 0 THEN n END AS page_printed_start FROM s""")
def stored_sections(spark, sf):
    """Sections in the rebuilt index: the path is stored as JSON and read back as an array."""
    path = _new_path(spark)
    tables.rebuild({"sections": tables.path_json(S.sections(spark, sf))}, path)
    back = spark.read.parquet(f"{path}/sections")
    whole = tables.path_array(back.withColumn("stored", F.col("level_path")))
    return whole.select("section_id", "stored", F.array_join("level_path", " > ").alias("path"), "page_printed_start")


@query("""SELECT 'sections' AS table_name, count(DISTINCT doc_id // 100) AS n_rows FROM documents UNION ALL SELECT 'chunks', count(*) FROM documents UNION ALL SELECT 'lengths', count(*) FROM documents
UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL
SELECT 'postings', sum(list_sum(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z가-힣]+'), lambda w: greatest(length(w) - 1, 1))))::BIGINT FROM documents""")
def rebuilt_index(spark, sf):
    """The index tables written anew, and their row counts."""
    path = _new_path(spark)
    built = {"sections": S.sections(spark, sf), "chunks": S.chunks(spark, sf), **jobs.index(S.chunks(spark, sf)), "vectors": S.vectors(spark, sf)}
    tables.rebuild(built, path)
    return checks.row_counts({name: spark.read.parquet(f"{path}/{name}") for name in built})


@query("""SELECT source AS doc_id, CASE WHEN source IN ('src1', 'src2') THEN 2 ELSE 1 END AS version, count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents GROUP BY ALL""")
def rebuilt_subset(spark, sf):
    """A stored table in which two documents were built anew; the others stay as they are."""
    path = _new_path(spark)
    rows = S.chunks(spark, sf).select("doc_id", "chunk_id", "text").withColumn("version", F.lit(1))
    rows.write.partitionBy("doc_id").parquet(path)
    tables.rebuild_docs(rows.withColumn("version", F.lit(2)), path, ["src1", "src2"])
    return spark.read.schema(rows.schema).parquet(path).groupBy("doc_id", "version").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


_REUSED = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), o AS (SELECT DISTINCT t FROM d WHERE doc_id % 2 = 0)
SELECT doc_id::VARCHAR AS chunk_id, CASE WHEN t IN (SELECT t FROM o) THEN -1 ELSE length(t) + 11 END::DOUBLE AS first, CASE WHEN t IN (SELECT t FROM o) THEN -1 ELSE length(t) - length(replace(t, 'e', '')) + 1 END::DOUBLE AS second FROM d"""


@query(_REUSED)
def reused_vectors(spark, sf):
    """Vectors by digest: texts of even documents have stored ones, only new texts are embedded, each once."""
    c = S.chunks(spark, sf)
    c = c.withColumn("text_for_embedding", X.embedding_text(F.lit("Man"), F.array(F.lit("x")), F.concat(F.lit("1\n2"), F.col("text"))))
    stored = c.where("chunk_id % 2 = 0").select(tables.digest("m").alias("digest")).distinct().withColumn("embedding", F.array(F.lit(-1.0), F.lit(-1.0)).cast("array<float>"))

    def call(texts):
        return [[float(len(t)), float(t.count("e") + 1)] for t in texts]

    got = tables.vectors(c, stored, "m", call)
    return got.select("chunk_id", F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[1].cast("double").alias("second"))


@query(_REUSED)
def grown_vectors(spark, sf):
    """The stored vector table over two runs: even documents first, then all; the second run, made twice, stores only what is new."""
    c = S.chunks(spark, sf)
    c = staged(c.withColumn("text_for_embedding", X.embedding_text(F.lit("Man"), F.array(F.lit("x")), F.concat(F.lit("1\n2"), F.col("text")))))
    store = Store(spark, _new_path(spark))
    tables.grow_vectors(store, c.where("chunk_id % 2 = 0"), "m", lambda texts: [[-1.0, -1.0]] * len(texts))

    def call(texts):
        return [[float(len(t)), float(t.count("e") + 1)] for t in texts]

    tables.grow_vectors(store, c, "m", call)
    got = tables.grow_vectors(store, c, "m", lambda texts: [[-2.0, -2.0]] * len(texts))
    return got.select("chunk_id", F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[1].cast("double").alias("second"))


@query("""
WITH r AS (SELECT unnest([1, 2]) AS as_of)
SELECT as_of, source AS doc_id, CASE WHEN as_of = 2 AND source IN ('src1', 'src2') THEN 2 ELSE 1 END AS written, count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS chars
FROM documents, r GROUP BY ALL""")
def stored_versions(spark, sf):
    """A table by documents, two of which were built anew: both versions, each read whole."""
    rows = S.chunks(spark, sf).select("doc_id", "chunk_id", "text").withColumn("written", F.lit(1))
    store = Store(spark, _new_path(spark))
    store.publish({"chunks": rows}, by_document=("chunks",), buckets=16)
    store.replace("chunks", rows.withColumn("written", F.lit(2)), rows.select("doc_id").where(F.col("doc_id").isin("src1", "src2")))
    both = store.read("chunks", 1).withColumn("as_of", F.lit(1)).unionByName(store.read("chunks", 2).withColumn("as_of", F.lit(2)))
    return both.groupBy("as_of", "doc_id", "written").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("WITH " + _LINES + "SELECT doc_id, page_pdf::INTEGER AS page_pdf, line_no::INTEGER AS line_no, md5(text) AS text_md5, y0, bold FROM l")
def stored_lines(spark, sf):
    """Lines written as JSON and read back by their schema."""
    rows = S.lines(spark, sf)
    path = _new_path(spark)
    tables.write_json(rows.select(*[c for c in tables.columns("lines").names if c in rows.columns]), path)
    return tables.read(spark, "lines", path, "json").select("doc_id", "page_pdf", "line_no", _md5("text").alias("text_md5"), "y0", "bold")


@query(CASES + "SELECT id, type, 's' || (i * 7919 % (last + 1)) || ',s' || (i * 104729 % (last + 3)) AS answers, md5(text) AS needle FROM c, ns")
def stored_cases(spark, sf):
    """Ground truth written as JSON lines and read back by its schema."""
    path = _new_path(spark)
    tables.write_json(benchmark_cases(spark, sf), path)
    back = tables.read(spark, "ground_truth", path, "json")
    return back.select("id", "type", F.array_join("answer_sections", ",").alias("answers"), F.md5(F.get("must_contain", F.lit(0)).cast("binary")).alias("needle"))
