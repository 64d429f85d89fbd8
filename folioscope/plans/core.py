"""Registered queries of the operators, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import rules as R
from folioscope.functions import text as X
from folioscope.functions import urls as U
from folioscope.operators import chunking, guardrails, handoff, html, hybrid, intent, keyword, quality, refresh, requests, sections, vectors
from folioscope.plans.base import query, table
from folioscope.sources import scratch

SITE = "example.com"


# -- urls -----------------------------------------------------------------------------------------------------------

_HOST = r"regexp_replace(lower(regexp_replace(regexp_extract(trim(url), '^(?i)([a-z][a-z0-9+.-]*)://([^/?#]*)([^?#]*)', 2), '^.*@|:\d*$', '')), '^www\.', '')"
_PATH = r"regexp_replace(regexp_extract(trim(url), '^(?i)([a-z][a-z0-9+.-]*)://([^/?#]*)([^?#]*)', 3), '/+', '/', 'g')"
_CANON = f"""SELECT page_id, url, {_HOST} AS host, CASE WHEN length({_PATH}) > 1 THEN regexp_replace({_PATH}, '/$', '') ELSE {_PATH} END AS path FROM pages"""
_CANONICAL = "CASE WHEN host <> '' THEN 'https://' || host || path END"


@query(f"SELECT page_id, host, path, {_CANONICAL} AS canonical, regexp_extract(path, '[^/]*$') AS slug FROM ({_CANON})")
def url_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.host(url).alias("host"), U.path(url).alias("path"), U.canonical(url).alias("canonical"), U.slug(url).alias("slug"))


def _allowlist(pages: DataFrame) -> DataFrame:
    """All canonical pages of hosts that have at least ten."""
    hosts = pages.groupBy(U.host(F.col("url")).alias("h")).agg(F.count("*").alias("n")).where("n >= 10")
    kept = pages.withColumn("h", U.host(F.col("url"))).join(hosts, "h", "left_semi")
    return kept.select(U.canonical(F.col("url")).alias("url")).distinct()


_ALLOWED = f"WITH c AS ({_CANON}), big AS (SELECT host FROM c GROUP BY host HAVING count(*) >= 10), allowed AS (SELECT DISTINCT {_CANONICAL} AS a FROM c WHERE host IN (SELECT host FROM big))"


@query(f"{_ALLOWED} SELECT page_id, url FROM c WHERE {_CANONICAL} IN (SELECT a FROM allowed)")
def url_allowlist_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return U.keep_allowed(pages, "url", _allowlist(pages))


@query(f"{_ALLOWED} SELECT page_id, url FROM c WHERE {_CANONICAL} NOT IN (SELECT a FROM allowed)")
def url_allowlist_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return U.keep_allowed(pages, "url", _allowlist(pages), negate=True)


@query(f"""WITH c AS (SELECT *, {_CANONICAL} AS canon, regexp_extract(path, '[^/]*$') AS scheme FROM ({_CANON}))
SELECT 'not_canonical' AS issue, count(*) FILTER (WHERE canon IS DISTINCT FROM url) AS n FROM c
UNION ALL SELECT 'path_not_scheme', 0 FROM (SELECT 1) UNION ALL SELECT 'inactive', 0 FROM (SELECT 1)
UNION ALL SELECT 'row_count', abs(count(*) - 16) FROM c
UNION ALL SELECT 'repeated_url', count(*) FROM (SELECT url FROM c GROUP BY url HAVING count(*) > 1)
UNION ALL SELECT 'repeated_scheme', count(*) FROM (SELECT scheme FROM c GROUP BY scheme HAVING count(*) > 1)""")
def registry_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("url", U.slug(F.col("url")).alias("scheme"))
    return quality.registry_issues(pages, "scheme", "url", None, 16)


# -- pages ----------------------------------------------------------------------------------------------------------


@query("SELECT page_id, " + " OR ".join(f"contains(lower(html), '{m}')" for m in [*X.RAW_CHALLENGE, "track("]) + " AS challenge FROM pages")
def challenge_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.challenge_flag(F.col("html"), extra=["track("], limit=None).alias("challenge"))


@query()
def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.visible_text("html").alias("text"))


@query()
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.html_to_markdown(table(spark, sf_dir, "pages"), "page_id", "html", most=None)


# -- lines, sections, chunks ----------------------------------------------------------------------------------------

_BOILER = """WITH n AS (SELECT CASE WHEN count(*) <= 1 THEN 1 ELSE greatest(2, least(15, count(*) - 1)) END AS need FROM documents),
lines AS (SELECT DISTINCT doc_id, trim(unnest(string_split(coalesce(text, ''), chr(10)))) AS line FROM documents),
block AS (SELECT line, count(*) AS n_docs FROM lines WHERE length(line) BETWEEN 3 AND 120 AND line NOT IN ('We are hiring!', 'Help', 'Download App', 'Open App')
  AND NOT regexp_matches(line, '[%₹]|[0-9]{3,}|[0-9]\\.[0-9]') GROUP BY line HAVING count(*) >= (SELECT need FROM n))"""


@query(f"{_BOILER} SELECT line, n_docs FROM block")
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.boilerplate_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(_BOILER + r""", parts AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
judged AS (SELECT doc_id, raw, pos, trim(raw) IN (SELECT line FROM block) AS gone FROM parts),
joined AS (SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS t, count(*) FILTER (WHERE gone) AS lines_removed FROM judged GROUP BY doc_id),
bare AS (SELECT doc_id, lines_removed, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM joined)
SELECT doc_id, CASE WHEN t = '' THEN '' ELSE t || chr(10) END AS text, lines_removed FROM bare""")
def boilerplate_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return html.without_lines(docs.select("doc_id", "text"), "doc_id", "text", html.boilerplate_lines(docs, "doc_id", "text"))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as Markdown, a heading for each turn."""
    turns = table(spark, sf_dir, "conversations")
    part = F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), F.col("text"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))).alias("t"))
    return rows.select("conv_id", F.array_join(F.col("t.p"), "\n\n").alias("md"))


_MD = r"""WITH docs AS (SELECT conv_id AS id, string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn, text) AS md FROM conversations GROUP BY conv_id),
split AS (SELECT id, length(md) AS total, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS pos FROM docs),
lines AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start FROM split)"""


@query(_MD + r""", heads AS (SELECT id, total, length(regexp_extract(line, '^(#{1,6})[ \t]+(.+?)[ \t]*$', 1)) AS level, regexp_extract(line, '^(#{1,6})[ \t]+(.+?)[ \t]*$', 2) AS title, start
  FROM lines WHERE regexp_matches(line, '^(#{1,6})[ \t]+(.+?)[ \t]*$'))
SELECT id, row_number() OVER w - 1 AS ordinal, level, title, start AS start_char, coalesce(lead(start) OVER w, total) AS end_char FROM heads WINDOW w AS (PARTITION BY id ORDER BY start)""")
def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.heading_sections(_conversations(spark, sf_dir), "conv_id", "md")


_DOC_LINES = r"""WITH split AS (SELECT doc_id AS id, length(text) AS total, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
lines AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start FROM split),"""


@query(_DOC_LINES + """
marked AS (SELECT *, least(start + length(line) + 1, total) AS stop, trim(line) <> '' AND contains(line, '|') AS t FROM lines),
runs AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) - row_number() OVER (PARTITION BY id, t ORDER BY pos) AS run FROM marked)
SELECT id, min(start) AS start_char, max(stop) AS end_char FROM runs WHERE t GROUP BY id, run""")
def table_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.table_spans(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(_DOC_LINES + """
next AS (SELECT *, lead(line) OVER w AS after, lead(line, 2) OVER w AS later FROM lines WINDOW w AS (PARTITION BY id ORDER BY pos)),
marked AS (SELECT *, CASE WHEN later IS NOT NULL AND trim(after) = '' THEN start + length(line) ELSE least(start + length(line) + 1, total) END AS stop,
  trim(line) <> '' AND NOT contains(line, '|') AS t FROM next),
runs AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) - row_number() OVER (PARTITION BY id, t ORDER BY pos) AS run FROM marked)
SELECT id, min(start) AS start_char, max(stop) AS end_char FROM runs WHERE t GROUP BY id, run""")
def paragraph_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.paragraph_spans(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def chunk_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sliding_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def chunk_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunker as a table function in SQL; a test holds it against chunk_sliding."""
    chunking.register_chunk(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("chunked_documents")
    return spark.sql("SELECT c.* FROM chunked_documents d, LATERAL chunk(d.doc_id, d.text) c")


@query("SELECT doc_id, greatest(1, floor(length(text) / 4.0))::INTEGER AS estimated_tokens, greatest(1, floor(length(text) / 4.0)) > 512 AS exceeds_context FROM documents")
def context_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.context_flags(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")


# -- personal data, hashes, duplicates ------------------------------------------------------------------------------


def _pii_sql(column: str) -> list[str]:
    steps = [column]
    for label, pattern in X.PII:
        steps.append(f"regexp_replace({steps[-1]}, '{pattern}', '[{label}_REDACTED]', 'g')")
    return steps


@query(f"SELECT doc_id, {_pii_sql('text')[-1]} AS text FROM documents")
def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.redact(F.col("text")).alias("text"))


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all({t}, '{p}')) AS {label.lower()}" for (label, p), t in zip(X.PII, _pii_sql("text"), strict=False)) + " FROM documents")
def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in X.pii_counts(F.col("text")).items()])


_STABLE = "sha256(trim(regexp_replace(coalesce((SELECT string_agg(l, chr(10)) FROM (SELECT unnest(string_split({0}, chr(10))) AS l) WHERE NOT regexp_matches(l, '(?i)" + "|".join(X.VOLATILE) + "')), ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))"


def _stable(text: str) -> str:
    return _STABLE.replace("{0}", text)


_CHANGED = "CASE WHEN quality = 0 THEN text || ' edited' ELSE text END"


@query(f"SELECT doc_id, {_stable('text')} AS hash FROM documents")
def stable_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.stable_hash(F.col("text")).alias("hash"))


def _diff(spark: SparkSession, sf_dir: str, stored: Callable[[DataFrame], DataFrame] = lambda old: old) -> DataFrame:
    """Documents against a later state: those labelled poor were edited, toxic ones could not be fetched; unlabelled ones are new."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    old = docs.where("quality IS NOT NULL").select(F.col("doc_id").alias("url"), X.stable_hash(F.col("text")).alias("hash"))
    edited = F.when(F.col("quality") == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    new = docs.select(F.col("doc_id").alias("url"), F.when(F.coalesce("toxic", F.lit(0)) == 0, X.stable_hash(edited)).alias("hash"))
    return refresh.diff_hashes(stored(old), new)


_DIFF = f"""SELECT doc_id AS url, CASE WHEN quality IS NOT NULL THEN {_stable('text')} END AS old_hash, CASE WHEN coalesce(toxic, 0) = 0 THEN {_stable(_CHANGED)} END AS new_hash
FROM documents LEFT JOIN labels USING (doc_id)"""
_DIFFED = f"SELECT url, old_hash, new_hash, CASE WHEN new_hash IS NULL THEN 'failed' WHEN old_hash IS NULL THEN 'baseline' WHEN old_hash = new_hash THEN 'unchanged' ELSE 'changed' END AS status FROM ({_DIFF})"


@query(_DIFFED)
def refresh_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)


@query(_DIFFED)
def refresh_diff_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the old hashes in a bucketed store, which is not shuffled."""
    name = f"hash_store_{uuid4().hex}"
    store = scratch.new_path(spark, "hash_store")
    return _diff(spark, sf_dir, lambda old: refresh.write_store(old, name, store))


@query(f"""SELECT n_baseline, n_changed, n_unchanged, n_failed, n_removed, n_changed >= 3 AS frozen, CASE WHEN n_changed >= 3 THEN 0 ELSE n_changed END AS n_reingest FROM (
SELECT count(*) FILTER (WHERE status = 'baseline') AS n_baseline, count(*) FILTER (WHERE status = 'changed') AS n_changed, count(*) FILTER (WHERE status = 'unchanged') AS n_unchanged,
count(*) FILTER (WHERE status = 'failed') AS n_failed, 0::BIGINT AS n_removed FROM ({_DIFFED}))""")
def drift_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.drift_gate(_diff(spark, sf_dir))


@query(f"SELECT url, CASE WHEN status = 'failed' OR status = 'changed' THEN old_hash ELSE new_hash END AS hash FROM ({_DIFFED}) WHERE CASE WHEN status = 'failed' OR status = 'changed' THEN old_hash ELSE new_hash END IS NOT NULL")
def hash_store_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.next_hashes(_diff(spark, sf_dir), frozen=True)


_DEDUPE = "lower(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))"


@query(f"SELECT doc_id, {_DEDUPE} AS form, sha256({_DEDUPE}) AS hash FROM documents")
def dedupe_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.dedupe_form(F.col("text")).alias("form"), X.text_hash(F.col("text")).alias("hash"))


@query(f"""SELECT doc_id, source, n_copies FROM (SELECT doc_id, source, count(*) OVER w AS n_copies, row_number() OVER (w ORDER BY n_chars, doc_id) AS rn
FROM documents WINDOW w AS (PARTITION BY source, {_DEDUPE})) WHERE rn = 1""")
def dedupe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "text")
    return quality.dedupe_exact(docs, "source", "text", ["n_chars", "doc_id"]).select("doc_id", "source", "n_copies")


_NEAR = f"""WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split({_DEDUPE}, ' '), lambda x: x <> ''))) AS w FROM documents),
reps AS (SELECT min(doc_id) AS id, w FROM w WHERE len(w) > 0 GROUP BY w)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS jaccard
FROM reps a JOIN reps b ON a.id < b.id AND least(len(a.w), len(b.w)) >= 0.92 * greatest(len(a.w), len(b.w))
WHERE 100 * len(list_intersect(a.w, b.w)) >= 92 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))"""


@query(_NEAR)
def near_dup_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.near_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split({_DEDUPE}, ' '), lambda x: x <> ''))) AS w FROM documents)
SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY w) AS representative, count(*) OVER (PARTITION BY w) AS n_copies FROM w""")
def near_dup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.near_members(table(spark, sf_dir, "documents"), "doc_id", "text")


# a scan over the ids that have neighbours, in order: each is kept if none that was kept is near
@query(f"""WITH RECURSIVE pairs AS MATERIALIZED (SELECT a, b FROM ({_NEAR})),
nodes AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS pos, list(a) FILTER (WHERE a IS NOT NULL) AS before
  FROM (SELECT b AS id, a FROM pairs UNION SELECT a, NULL FROM pairs) GROUP BY id),
scan(pos, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT n.pos, CASE WHEN list_has_any(coalesce(n.before, []::BIGINT[]), kept) THEN kept ELSE list_append(kept, n.id) END FROM scan s JOIN nodes n ON n.pos = s.pos + 1),
last AS (SELECT kept FROM scan ORDER BY pos DESC LIMIT 1),
firsts AS (SELECT b, min(a) AS first FROM pairs, last WHERE list_contains(kept, a) GROUP BY b),
members AS (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY w) AS representative
  FROM (SELECT doc_id, list_sort(list_distinct(list_filter(string_split({_DEDUPE}, ' '), lambda x: x <> ''))) AS w FROM documents))
SELECT id, coalesce(first, representative) AS kept_id, id = coalesce(first, representative) AS kept FROM members LEFT JOIN firsts ON representative = b""")
def near_dup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.keep_first(table(spark, sf_dir, "documents"), "doc_id", "text")


# -- keyword and vector channels ------------------------------------------------------------------------------------


def _form_sql(t: str) -> str:
    t = rf"regexp_replace({t}, '(?i)₹|\brupees?\b', ' INR ', 'g')"
    t = rf"regexp_replace({t}, 'INR\s*([\d,]+(?:\.\d+)?)', 'INR \1', 'g')"
    t = rf"regexp_replace(replace({t}, ',', ''), '(\d+(?:\.\d+)?)\s*%', '\1 percent', 'g')"
    return rf"lower(trim(regexp_replace({t}, '[ \t\n\x0B\f\r]+', ' ', 'g')))"


_EXPANDED = "concat_ws(' ', text, " + ", ".join(f"CASE WHEN contains(lower(text), '{p}') THEN '{p.replace(' ', '_').replace('-', '_')}' END" for p in X.FACET_PHRASES) + ")"
_TOKENS = f"""docs AS (SELECT doc_id AS id, regexp_extract_all({_form_sql(_EXPANDED)}, '[a-z0-9]+') AS toks FROM documents),
lens AS (SELECT id, len(toks) AS dl FROM docs WHERE len(toks) > 0),
post AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM docs) GROUP BY ALL)"""


@query(f"SELECT doc_id, {_form_sql('text')} AS form FROM documents")
def keyword_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.keyword_form(F.col("text")).alias("form"))


@query(f"WITH {_TOKENS} SELECT term, count(*) AS df FROM post GROUP BY term")
def token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.build_index(table(spark, sf_dir, "documents"), "doc_id", "text").terms


@query(f"WITH {_TOKENS} SELECT count(*) AS n_docs, round(avg(dl), 6) AS avg_dl FROM lens")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = keyword.build_index(table(spark, sf_dir, "documents"), "doc_id", "text").stats
    return stats.select("n_docs", F.round("avg_dl", 6).alias("avg_dl"))


_BM25 = f"""{_TOKENS},
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all({_form_sql('text')}, '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
df AS (SELECT term, ln(1 + ((SELECT count(*) FROM lens) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY term),
score AS (SELECT query_id, id, round(sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM lens))))), 6) AS score
  FROM q JOIN df USING (term) JOIN post USING (term) JOIN lens USING (id) GROUP BY query_id, id),
kw AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM score) WHERE rank <= 5)"""


@query(f"WITH {_BM25} SELECT * FROM kw")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.bm25_topk(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("""WITH toks AS (SELECT item_id AS id, CASE WHEN len(regexp_extract_all(lower(text), '[a-z0-9%]+')) = 0 THEN ['_empty_'] ELSE regexp_extract_all(lower(text), '[a-z0-9%]+') END AS t FROM benchmark),
rows AS (SELECT id, unnest(t) AS tok, generate_subscripts(t, 1) - 1 AS i FROM toks),
dig AS (SELECT id, sha256('hash_v1:' || i || ':' || tok) AS h, unnest(range(16)) AS b FROM rows),
sums AS (SELECT id, ('0x' || substr(h, 2 * b::BIGINT + 1, 2))::INTEGER % 384 AS idx, sum(CASE WHEN ('0x' || substr(h, 2 * ((b + 7) % 32)::BIGINT + 1, 2))::INTEGER % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM dig GROUP BY ALL)
SELECT id, idx, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 9) AS value FROM sums QUALIFY v <> 0""")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.hash_embedding(table(spark, sf_dir, "benchmark"), "item_id", "text", "hash_v1")
    return rows.withColumn("value", F.round("value", 9))


def _vector_queries(spark: SparkSession, sf_dir: str, items: bool = False) -> DataFrame:
    """Every vector whose id is divisible by 100 asks for its neighbours; items: those with the number of a benchmark item, to be merged with the item's own question."""
    found = table(spark, sf_dir, "embeddings")
    if items:
        found = found.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    else:
        found = found.where("vec_id % 100 = 0")
    return found.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), "label")


_VEC_ITEMS = """vscore AS (SELECT q.vec_id AS query_id, d.vec_id AS id, q.label AS ql, d.label AS dl, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q CROSS JOIN embeddings d WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
vec AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vscore) WHERE rank <= 5)"""
_VEC = _VEC_ITEMS.replace("q.vec_id IN (SELECT item_id FROM benchmark)", "q.vec_id % 100 = 0")


@query(f"WITH {_VEC} SELECT * FROM vec")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.cosine_topk(table(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir))


@query(f"WITH {_VEC.replace('FROM vscore', 'FROM vscore WHERE ql = dl')} SELECT * FROM vec")
def cosine_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.cosine_topk(table(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir), key="label")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors.cosine_topk(table(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir, items=True))
    return hybrid.merge_channels(bm25_topk(spark, sf_dir), near)


_MERGED = f"""WITH {_BM25}, {_VEC_ITEMS}, merged AS (SELECT query_id, id, kw.score AS keyword, vec.score AS vector,
  list_filter([CASE WHEN kw.score IS NOT NULL THEN 'keyword' END, CASE WHEN vec.score IS NOT NULL THEN 'vector' END], lambda x: x IS NOT NULL) AS channels
  FROM kw FULL JOIN vec USING (query_id, id))"""
_NORM = "CASE WHEN {0} IS NULL THEN NULL WHEN max({0}) OVER w <= min({0}) OVER w THEN 1.0 ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END"


@query(f"{_MERGED} SELECT query_id, id, keyword, vector, array_to_string(channels, '+') AS channels FROM merged")
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).withColumn("channels", F.array_join("channels", "+"))


@query(f"""{_MERGED}, normed AS (SELECT *, {_NORM.format('keyword')} AS kn, {_NORM.format('vector')} AS vn FROM merged WINDOW w AS (PARTITION BY query_id)),
fused AS (SELECT query_id, id, keyword, vector, round(coalesce(greatest(kn, vn), 0), 6) AS fused FROM normed)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) AS rank FROM fused) WHERE rank <= 12""")
def hybrid_fused_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.fuse(_merged(spark, sf_dir)).drop("channels")


_RTOK = "list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower({0}), '[^\\w\\s%äöüßéèêçñóíúáâîÄÖÜÉÈÊÇÑÓÍ]', ' ', 'g'), '\\s+', ' ', 'g'), ' '), lambda x: length(x) >= 2 AND x NOT IN (" + ", ".join(f"'{w}'" for w in X.RERANK_STOP) + ")))"
_KEYWORDS = [k for ks in R.FACETS.values() for k in ks]
_ASKED = " + ".join(f"contains(lower(q), '{k}')::INTEGER" for k in _KEYWORDS)
_BOTH = " + ".join(f"(contains(lower(q), '{k}') AND contains(lower(coalesce(chunk, '')), '{k}'))::INTEGER" for k in _KEYWORDS)
_ZERO = "CASE WHEN {0} IS NULL THEN 0.0 WHEN max(coalesce({0}, 0)) OVER w <= min(coalesce({0}, 0)) OVER w THEN 1.0 ELSE ({0} - min(coalesce({0}, 0)) OVER w) / (max(coalesce({0}, 0)) OVER w - min(coalesce({0}, 0)) OVER w) END"


@query(f"""{_MERGED}, texts AS (SELECT m.*, d.text AS chunk, b.text AS q, {_RTOK.format('b.text')} AS qt, {_RTOK.format("coalesce(d.text, '')")} AS ct
  FROM merged m LEFT JOIN documents d ON d.doc_id = m.id LEFT JOIN benchmark b ON b.item_id = m.query_id),
scored AS (SELECT query_id, id, 0.45 * ({_ZERO.format('vector')}) + 0.45 * ({_ZERO.format('keyword')})
  + 0.25 * least(1.0, ({_BOTH}) / greatest(1, least(3, {_ASKED}))) + 0.15 * CASE WHEN len(qt) = 0 THEN 0.0 ELSE len(list_intersect(qt, ct)) / len(qt) END AS raw FROM texts WINDOW w AS (PARTITION BY query_id)),
ranked AS (SELECT query_id, id, round(raw, 6) AS final_score, row_number() OVER (PARTITION BY query_id ORDER BY round_even(raw / 0.0001, 0) DESC, id) AS rank FROM scored)
SELECT *, CASE WHEN rank = 1 THEN CASE WHEN final_score < 0.28 THEN 'not_found_in_sources' ELSE 'found' END END AS status FROM ranked""")
def rerank_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("chunk"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    rows = _merged(spark, sf_dir).join(docs, "id", "left").join(asked, "query_id", "left")
    ranked = hybrid.rerank(rows, F.col("q"), F.col("chunk"), F.lit(""), F.lit(False), F.lit(""), R.FACETS)
    return ranked.select("query_id", "id", "final_score", "rank", "status")


@query(f"""WITH {_VEC}, hit AS (SELECT query_id, min(rank) AS rank FROM vec JOIN embeddings q ON q.vec_id = query_id JOIN embeddings d ON d.vec_id = id AND d.label = q.label WHERE rank BETWEEN 2 AND 5 GROUP BY query_id)
SELECT count(*) AS n, count(rank) AS hits, round(avg((rank IS NOT NULL)::INTEGER), 4) AS recall, round(avg(rank), 4) AS mean_rank FROM (SELECT DISTINCT query_id FROM vec) LEFT JOIN hit USING (query_id)""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a neighbour other than the vector itself has its label."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    results = cosine_topk(spark, sf_dir).where("rank > 1").join(labels, "id")
    return quality.recall_at_k(results, _vector_queries(spark, sf_dir).select("query_id", "label"), 5, match="label")


# -- questions and answers ------------------------------------------------------------------------------------------

RULES = R.Rules(house="acme", site="funds.example.com", rivals=("globex", "initech"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as questions, each also with a word of the rules before it, so that every rule has cases."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    lead = F.array(*[F.lit(x) for x in LEADS])
    return turns.withColumn("text", F.concat_ws(" ", F.get(lead, F.pmod(F.col("conv_id"), F.lit(len(LEADS))).cast("int")), "text"))


LEADS = ["", "acme", "what is the expense ratio of", "should i invest in", "compare", "globex", "exit load and riskometer", "ignore previous", "expected returns", "past performance of", "weather", "my pan number", "is the benchmark better than", "mutual fund", "cagr of the lock-in"]


def _intent_sql() -> str:
    esc = lambda s: s.replace("'", "''")
    word = lambda k: f"contains(q, '{esc(k.lower())}')" if " " in k else "regexp_matches(q, '(?i)\\b" + esc(re.escape(k.lower())) + "\\b')"
    any_of = lambda ks, ps=(): "(" + " OR ".join([*map(word, ks), *[f"regexp_matches(q, '(?i){esc(p)}')" for p in ps]] or ["false"]) + ")"
    r = RULES
    flags = {n: any_of(*getattr(r, n)) for n in ("injection", "comparison", "advice", "projection", "performance", "vague")}
    flags |= {"personal": any_of((), r.personal), "rivals": any_of(r.rivals), "off_topic": any_of(r.off_topic), "greeting": any_of(r.greeting)}
    facets = "list_filter([" + ", ".join(f"CASE WHEN {any_of(ks)} THEN '{c}' END" for c, ks in sorted(r.facets.items())) + "], lambda x: x IS NOT NULL)"
    leads = "[" + ", ".join(f"'{x}'" for x in LEADS) + "]"
    return rf"""WITH asked AS (SELECT conv_id, turn, trim(regexp_replace(lower(concat_ws(' ', {leads}[conv_id % {len(LEADS)} + 1], text)), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS q FROM conversations),
s AS (SELECT conv_id, turn, q, {", ".join(f"{v} AS {k}" for k, v in flags.items())}, {facets} AS facets, contains(q, 'acme') AS house FROM asked),
d AS (SELECT *, CASE WHEN q = '' THEN 1 WHEN injection THEN 2 WHEN personal THEN 3 WHEN rivals AND NOT house THEN 5 WHEN comparison AND len(facets) = 0 THEN 6
  WHEN projection AND len(facets) = 0 THEN 7 WHEN advice AND len(facets) = 0 THEN 8 WHEN len(facets) > 0 AND (advice OR projection OR comparison) THEN 9 WHEN vague AND house THEN 10
  WHEN performance AND NOT projection AND len(facets) = 0 THEN 11 WHEN len(facets) > 0 THEN 12 WHEN off_topic AND NOT house THEN 13 WHEN greeting AND len(string_split(q, ' ')) <= 6 AND NOT house THEN 14
  WHEN house OR contains(q, 'mutual fund') OR contains(q, 'funds') THEN 15 ELSE 16 END AS k FROM s)
SELECT conv_id, turn, CASE WHEN k = 6 THEN 'comparison' WHEN k IN (7, 11) THEN 'performance-info' WHEN k IN (8, 9) THEN 'mixed' WHEN k IN (12, 15) THEN 'factual' ELSE 'out-of-scope' END AS intent,
  CASE WHEN k IN (1, 10, 14, 16) THEN 'disambiguate' WHEN k = 11 THEN 'performance_limited' WHEN k IN (12, 15) THEN 'retrieve' ELSE 'refuse' END AS action,
  (CASE WHEN k IN (1, 14, 15, 16) THEN 0.55 WHEN k IN (10, 11, 13) OR k = 12 AND len(facets) > 1 THEN 0.75 ELSE 0.92 END)::DOUBLE AS confidence,
  CASE WHEN k = 2 THEN 'R5' WHEN k IN (3, 5) THEN 'R3' WHEN k = 6 THEN 'R2' WHEN k = 7 THEN 'R1' WHEN k IN (8, 9) THEN 'R4' WHEN k = 11 THEN 'P1' WHEN k = 12 THEN facets[1] WHEN k = 15 THEN 'A0' ELSE 'O1' END AS policy_code,
  CASE WHEN k = 12 OR k = 9 AND len(facets) = 1 THEN facets[1] ELSE '' END AS facet,
  CASE WHEN k IN (1, 10, 14, 16) THEN 'disambiguate' WHEN k = 6 THEN 'comparison' WHEN k IN (7, 11) THEN 'performance_info' WHEN k IN (8, 9) THEN 'mixed_intent' ELSE 'out_of_scope' END AS refusal_type FROM d"""


@query(_intent_sql())
def intent_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intent.classify(_questions(spark, sf_dir), "text", RULES)
    return rows.select("conv_id", "turn", "intent", "action", "confidence", "policy_code", "facet", intent.refusal_type(F.col("intent"), F.col("action")).alias("refusal_type"))


_SENT = "list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@query(f"""SELECT conv_id, turn, len({_SENT}) AS plain, coalesce(list_sum(list_transform({_SENT}, lambda s: greatest(1, len(list_filter(string_split(s, ';'), lambda p: trim(p) <> ''))))), 0)::INTEGER AS clauses,
len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda p: trim(p) <> '')) AS stops FROM conversations""")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[X.sentence_count(t, m).alias(m) for m in ("plain", "clauses", "stops")])


_LINKED = "text || ' [page](https://funds.example.com/' || turn || ') and https://other.example.org/x'"


@query(rf"""SELECT conv_id, turn, len(regexp_extract_all({_LINKED}, '\[[^\]]+\]\(([^)]+)\)')) AS markdown_links, 3::INTEGER AS links,
trim(regexp_replace(regexp_replace(regexp_replace({_LINKED}, '\[[^\]]+\]\(([^)]+)\)', '', 'g'), '(?i)https?://[^\s)\]]+', '', 'g'), '\s{{2,}}', ' ', 'g')) AS bare FROM conversations""")
def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("text", F.lit(" [page](https://funds.example.com/"), F.col("turn").cast("string"), F.lit(") and https://other.example.org/x"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t"))
    site = "funds.example.com"
    return rows.select("conv_id", "turn", X.markdown_link_count(F.col("t")).alias("markdown_links"), X.link_count(F.col("t"), site).alias("links"), X.strip_links(F.col("t"), site).alias("bare"))


def _phrase_sql() -> str:
    q = "lower(trim(regexp_replace(regexp_replace(regexp_replace(concat_ws(' ', {}, text), '\"[^\"]*\"', ' ', 'g'), '''[^'']*''', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))".format(
        "[" + ", ".join(f"'{x}'" for x in LEADS) + f"][conv_id % {len(LEADS)} + 1]"
    )
    tests = []
    for label, phrases in R.ANSWER_PHRASES:
        for p in (x.strip() for x in phrases):
            test = f"contains(q, '{p}')" if " " in p else f"regexp_matches(q, '\\b{p}\\b')"
            tests.append(f"CASE WHEN {test} THEN '{label}:{p}' END")
    tests += [f"CASE WHEN regexp_matches(q, '(?i){p}') THEN 'regex:{p}' END" for p in R.ANSWER_PATTERNS]
    return f"SELECT conv_id, turn, concat_ws('|', {', '.join(tests)}) AS hits FROM (SELECT conv_id, turn, {q} AS q FROM conversations)"


@query(_phrase_sql())
def prohibited_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _questions(spark, sf_dir)
    return rows.select("conv_id", "turn", F.array_join(X.phrase_hits(F.col("text"), R.ANSWER_PHRASES, R.ANSWER_PATTERNS), "|").alias("hits"))


_NUM = X.NUMBER
_NFORM = "regexp_replace(replace(lower({0}), 'percent', '%'), '[\\s,₹]', '', 'g')"


@query(f"""SELECT doc_id, len(nums) AS n_numbers, array_to_string(list_filter(nums, lambda n: NOT contains({_NFORM.format('later')}, {_NFORM.format('n')})), '|') AS uncited FROM (
SELECT doc_id, coalesce(substr(text, 1 + length(text) // 2), '') AS later, list_transform(regexp_extract_all(coalesce(text, ''), '{_NUM}'), lambda n: trim(n)) AS nums FROM documents)""")
def number_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of each document that its second half doesn't have."""
    t = F.col("text")
    later = F.expr("substring(text, 1 + length(text) div 2)")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.numbers(t)).alias("n_numbers"), F.array_join(X.uncited_numbers(t, later), "|").alias("uncited"))


POLICY = guardrails.Policy()


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as turns of conversations give them: some have links, foreign citations, no footer or no disclaimer."""
    rows = _questions(spark, sf_dir)
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    body = F.when(k == 1, F.concat("text", F.lit(" see https://funds.example.com/a"))).otherwise(F.col("text"))
    cited = F.when(k == 2, "https://other.example.org/x").otherwise("https://www.funds.example.com/funds/a/?x=1")
    return rows.select(
        "conv_id", "turn", F.lit("factual").alias("answer_type"), body.alias("body_text"), cited.alias("citation_url"), F.concat(F.lit("[a]("), cited, F.lit(")")).alias("citation_markdown"),
        F.when(k == 3, "").otherwise(POLICY.disclaimer).alias("disclaimer_line"), F.when(k == 4, "").otherwise(POLICY.footer + "01 Jan 2025").alias("footer_line"), F.lit("01 Jan 2025").alias("footer_date"),
        F.col("text").alias("chunk_text"),
    )


@query()
def validate_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guardrails.validate(_drafts(spark, sf_dir), POLICY).select("conv_id", "turn", "passed", F.col("violations.code").alias("codes"))


@query()
def repair_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = guardrails.validate_and_repair(_drafts(spark, sf_dir), POLICY)
    return done.select("conv_id", "turn", "answer_type", "passed", "repair_actions", F.col("violations.code").alias("codes"), guardrails.display_text(POLICY).alias("display"))


@query()
def compliance_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intent.classify(_questions(spark, sf_dir), "text", RULES)
    refused = F.col("action").isin("refuse", "disambiguate")
    outcomes = rows.select(
        "conv_id", "turn", F.col("text").alias("query"), F.when(refused, "refusal").otherwise("retrieval").alias("outcome_type"),
        F.when(refused, intent.refusal_type(F.col("intent"), F.col("action"))).otherwise("").alias("refusal_type"), (F.col("action") == "performance_limited").alias("performance_limited"),
        F.lit("found").alias("retrieval_status"), F.when(F.length("text") > 200, F.col("text")).otherwise("").alias("chunk_text"), F.lit("").alias("not_found_reason"),
    )
    return guardrails.route(outcomes).select("conv_id", "turn", "decision", "route", "reasons", "sanitized_query")


@query()
def compose_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("chunk_text"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    best = bm25_topk(spark, sf_dir).where("rank = 1").join(docs, "id").join(asked, "query_id")
    rows = best.withColumns({"section_title": F.lit("(document)"), "effective_date": F.lit("2025-01-31"), "citation_url": F.lit(POLICY.default_url), "performance_limited": F.lit(False)})
    return guardrails.compose_factual(rows, POLICY).select("query_id", "id", "facet_detected", "body_text", "footer_line")


@query()
def facet_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _questions(spark, sf_dir).select(F.concat_ws("/", "conv_id", "turn").alias("id"), "text")
    return handoff.facet_candidates(rows, "id", "text")


@query()
def quarantine_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.html_to_markdown(table(spark, sf_dir, "pages"), "page_id", "html", most=None)
    args = [F.col("extract_status"), F.col("normalize_status"), F.octet_length("markdown"), F.lit(None).cast("string")]
    return pages.select("page_id", handoff.parse_success(*args).alias("success"), handoff.quarantine_reasons(*args).alias("reasons"))


# -- rollups and requests -------------------------------------------------------------------------------------------


@query("""SELECT status, n, bytes, round(n / sum(n) OVER (), 4) AS share FROM (
SELECT CASE WHEN quality IS NULL THEN 'unknown' WHEN quality = 1 THEN 'ok' ELSE 'partial' END AS status, count(*) AS n, coalesce(sum(octet_length(encode(text))), 0)::BIGINT AS bytes FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)""")
def quality_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "ok").when(F.col("quality") == 0, "partial")
    return quality.status_rollup(docs.select(status.alias("status"), F.octet_length("text").alias("n_bytes")), "status", "n_bytes")


@query("""SELECT suite, count(*) AS n, count(*) FILTER (WHERE passed) AS passed, round(count(*) FILTER (WHERE passed) / count(*), 4) AS pass_rate,
CASE WHEN suite IS NOT NULL THEN round(count(*) FILTER (WHERE passed) / count(*), 4) >= CASE suite WHEN 'en' THEN 0.9 WHEN 'de' THEN 0.8 ELSE 0.0 END END AS ok
FROM (SELECT lang AS suite, toxic = 0 AS passed FROM documents JOIN labels USING (doc_id)) GROUP BY ROLLUP (suite)""")
def suite_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return quality.pass_rates(rows.select(F.col("lang").alias("suite"), (F.col("toxic") == 0).alias("passed")), {"en": 0.9, "de": 0.8})


@query("SELECT count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS n_ok, floor(avg(CASE WHEN event_type <> 'error' THEN nullif(value, 0) END))::BIGINT AS avg_latency FROM events")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.latency_summary(table(spark, sf_dir, "events"), "value", F.col("event_type") != "error")


@query("""WITH b AS (SELECT event_id, event_type, props, CASE WHEN user_id % 4 = 0 THEN 'text/plain' ELSE 'Application/JSON; charset=utf-8' END AS ct FROM events)
SELECT event_id, CASE WHEN ct = 'text/plain' THEN 'unsupported_media_type' WHEN props IS NULL OR NOT json_valid(props) OR json_type(props) <> 'OBJECT' THEN 'invalid_json' ELSE 'missing_query' END AS code, CASE WHEN ct = 'text/plain' THEN 415 ELSE 400 END AS status FROM b""")
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("user_id") % 4 == 0, "text/plain").otherwise("Application/JSON; charset=utf-8")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("body"), kind.alias("content_type"))
    return requests.validate(rows, "content_type", "body").select("event_id", "code", "status")


@query(f"""WITH c AS (SELECT *, {_CANONICAL} AS canon FROM ({_CANON}))
SELECT page_id::VARCHAR AS chunk_id, 'missing_doc_type' AS code, false AS hard FROM c
UNION ALL SELECT page_id::VARCHAR, 'invalid_source_url', true FROM c WHERE canon IS NULL OR host NOT LIKE '%.example.org'""")
def chunk_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    url = F.when(U.host(F.col("url")).endswith(".example.org"), F.col("url")).otherwise("")
    rows = pages.select(F.col("page_id").cast("string").alias("chunk_id"), F.col("html").alias("text"), "url", F.lit("s").alias("scheme"), F.lit(" ").alias("doc_type"), url.alias("source_url"))
    return quality.chunk_errors(rows, required=("chunk_id", "text", "scheme", "doc_type"))


@query("""SELECT source, count(*) AS n_in, count(*) FILTER (WHERE quality = 1) AS n_out, coalesce(sum(toxic), 0)::BIGINT AS hard_errors,
CASE WHEN coalesce(sum(toxic), 0) > 0 THEN 'failed_validation' WHEN count(*) FILTER (WHERE quality = 1) = 0 THEN 'excluded_empty_after_dedupe' ELSE 'validated' END AS status FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def bundle_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return quality.bundle_states(rows.select("source", (F.col("quality") == 1).alias("kept"), F.col("toxic").alias("hard_errors")), "source")


FRESH_SQL = "SELECT count(*) AS n, count(*) FILTER (WHERE ts >= m - INTERVAL 10 DAY) AS fresh, round(count(*) FILTER (WHERE ts >= m - INTERVAL 10 DAY) / count(*), 4) AS share FROM events, (SELECT max(ts) AS m FROM events)"


@query(FRESH_SQL)
def freshness_sla(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    latest = events.agg(F.max("ts").alias("now"))
    rows = events.crossJoin(F.broadcast(latest)).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at"), "now")
    return quality.freshness_sla(rows, "at", F.col("now"), 10)
