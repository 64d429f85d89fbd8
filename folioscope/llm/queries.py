"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bestfit, bpe, deltalloyd, filteraudit, hilbert, langid, linededup, mixing, partenum, shiftand, subspace, surrogates, tiff
from folioscope.llm.common import written

RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = bpe.read_rank_file(public_tokenizers.path(RANKS))
    coded = bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, out=("n_tokens", "ids_sha256", "decoded_sha256"))
    return coded.drop("text")


#: In production the key comes from a secret store; results are the same for the same key.
PII_KEY = b"folioscope-demo-key"


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, PII_KEY)


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        "lang",
        "source",
        "n_chars",
    )
    sharded = hilbert.hilbert_shards(rows, ("lang", "source", "n_chars"), n_shards=40, bits=4)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def op4_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def held_out(id_col: str = "doc_id") -> Column:
    """True for a third of the ids by hash, and for null: those that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs.where(~held_out()), "text", "lang", "doc_id")
    return langid.predict_languages(docs.select("doc_id", held_out().alias("held_out"), "text"), net).drop("text")


def op6_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.store_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), layouts=tiff.LAYOUTS).drop("text")


URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op7_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shiftand.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return docs.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def op9_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.shingle_groups(table(spark, sf_dir, "documents"), partenum.Scheme(words=3, num=90, den=100), slices=2)


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.poisson_mix(docs, size=F.octet_length(F.coalesce("text", F.lit("")))).withColumn("rate", F.round("rate", 9))


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return deltalloyd.with_inertia(deltalloyd.cluster(vectors, k=40, rounds=5, dim=64, scale=256, seed="2:")).drop("q")


def text_filters(text: Column) -> dict[str, Column]:
    """Conditions on which a text fails: few words, repeated words, capitals, markup characters."""
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    judged = docs.select("doc_id", "lang", filteraudit.digest(text).alias("digest"), *[c.alias(k) for k, c in text_filters(text).items()])
    judged = filteraudit.later_copies(written(judged, "judged"), "doc_id", "digest", "E").drop("digest")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic")
    )
    rows = judged.join(labels, "doc_id", "left")
    return filteraudit.audit(rows, F.col("lang"), {k: F.col(k) for k in "ABCDE"}, {k: F.col(k) for k in ("good", "toxic")}).drop("filter")


def op13_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = bestfit.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    return bestfit.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, capacity=2048, end_id=0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_hilbert_shards": op3_hilbert_shards,
    "op4_subspace_join": op4_subspace_join,
    "op5_byte_cnn": op5_byte_cnn,
    "op6_tiff": op6_tiff,
    "op7_url_automaton": op7_url_automaton,
    "op8_line_runs": op8_line_runs,
    "op9_partenum": op9_partenum,
    "op10_poisson_mix": op10_poisson_mix,
    "op11_delta_lloyd": op11_delta_lloyd,
    "op12_filter_audit": op12_filter_audit,
    "op13_best_two_fit": op13_best_two_fit,
}

_BARE = r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



def shingle_sql(words: int, num: int, den: int) -> str:
    """Components of documents whose sets of shingles of so many words have 100 num / den percent in common."""
    return rf"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < {words} THEN array_to_string(w, ' ')
    ELSE array_to_string(w[i:i + {words - 1}], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 2}, 2))) AS i FROM tokens WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE {den} * k >= {num} * (x.n + y.n - k)
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, least(d.doc_id, coalesce(min(b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id"""


def lloyd_sql(k: int, rounds: int, dim: int, scale: int, seed: str) -> str:
    """Lloyd's rounds as a chain of tables: one row for each vector (or centroid) and dimension."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), vec AS MATERIALIZED (SELECT r, unnest(q) AS x, unnest(range({dim})) AS i FROM kept),
start AS (SELECT row_number() OVER (ORDER BY sha256('{seed}' || vec_id) NULLS LAST, q) - 1 AS c, q FROM kept),
centroid0 AS MATERIALIZED (SELECT c, unnest(q) AS x, unnest(range({dim})) AS i FROM start WHERE c < {k})"""
    ]
    for n in range(rounds + 1):
        steps.append(f"""owned{n} AS MATERIALIZED (
  SELECT r, c, d FROM (
    SELECT r, c, sum((vec.x - centroid{n}.x) * (vec.x - centroid{n}.x)) AS d FROM vec JOIN centroid{n} USING (i) GROUP BY r, c
  ) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1
)""")
        if n < rounds:
            steps.append(f"""moved{n} AS MATERIALIZED (
  SELECT c, i, (s - ((s % n) + n) % n) // n AS x FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM owned{n} JOIN vec USING (r) GROUP BY c, i)
), centroid{n + 1} AS MATERIALIZED (
  SELECT c, i, coalesce(m.x, o.x)::BIGINT AS x FROM centroid{n} o LEFT JOIN moved{n} m USING (c, i)
)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM owned{rounds} JOIN kept USING (r) JOIN (SELECT c, sha256(string_agg(x, ',' ORDER BY i)) AS centroid_sha256 FROM centroid{rounds} GROUP BY c) USING (c)"""


ORACLES: dict[str, str] = {
    "op11_delta_lloyd": lloyd_sql(40, 5, 64, 256, "2:"),
    "op12_filter_audit": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), judged AS (
  SELECT part, quality = 1 AS good, toxic = 1 AS toxic, {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
    'E': doc_id > min(doc_id) OVER (PARTITION BY text)} AS f
  FROM words LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)
), fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN f.A THEN 'A' ELSE '' END) || (CASE WHEN f.B THEN 'B' ELSE '' END) || (CASE WHEN f.C THEN 'C' ELSE '' END)
    || (CASE WHEN f.D THEN 'D' ELSE '' END) || (CASE WHEN f.E THEN 'E' ELSE '' END) AS failed FROM judged
), kinds AS (SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM fails GROUP BY ALL),
orders(o) AS (
  SELECT '' UNION ALL SELECT o || x FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(o, x)
), steps AS (SELECT o AS filter_order, unnest(range(1, 6)) AS step FROM orders WHERE length(o) = 5),
states AS (SELECT filter_order, step, substr(filter_order, 1, step - 1) AS before, substr(filter_order, step, 1) AS here FROM steps),
counted AS (
  SELECT part, filter_order, step, here,
    sum(CASE WHEN before = '' OR NOT regexp_matches(failed, '[' || before || 'x]') THEN 1 ELSE 0 END * CASE WHEN contains(failed, here) THEN 0 ELSE n END) AS kept,
    sum(n) FILTER (WHERE contains(failed, here) AND NOT regexp_matches(failed, '[' || before || 'x]')) AS removed,
    sum(n) FILTER (WHERE contains(failed, here)) AS failing,
    sum(n) FILTER (WHERE failed = here) AS unique_fails,
    sum(good) FILTER (WHERE contains(failed, here) AND NOT regexp_matches(failed, '[' || before || 'x]')) AS good_lost,
    sum(toxic) FILTER (WHERE contains(failed, here) AND NOT regexp_matches(failed, '[' || before || 'x]')) AS toxic_lost
  FROM kinds, states GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  (coalesce(failing, 0) - coalesce(removed, 0))::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, here))::BIGINT AS shapley
FROM counted""",
    "op7_url_automaton": rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(verdict, h, p) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
fit AS (
  SELECT page_id, host, path, verdict, h || p AS rule,
    row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS n
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE n = 1""",
    "op8_line_runs": rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (SELECT doc_id, line, pos, translate({_BARE}, '{_UPPER}', '{_LOWER}') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT doc_id, line, pos, c.k IS NOT NULL AND doc_id <> keep AS gone FROM keyed LEFT JOIN common c ON keyed.k = c.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op4_subspace_join": """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN degree ON degree.a = vec_id LEFT JOIN least ON least.a = vec_id""",
    "op9_partenum": shingle_sql(3, 90, 100),
    "op10_poisson_mix": """
WITH RECURSIVE sizes AS (
  SELECT source, sum(octet_length(encode(coalesce(text, ''))))::DOUBLE AS size FROM documents GROUP BY source
), rates AS (
  SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE) * (SELECT sum(size) FROM sizes) / size AS rate FROM sizes
), parts AS (
  SELECT source, rate, greatest(ceil(rate / 64.0), 1)::INTEGER AS n_parts, rate / greatest(ceil(rate / 64.0), 1) AS mean FROM rates
), cdf(source, mean, k, p, c) AS (
  SELECT source, mean, 0, exp(-mean), exp(-mean) FROM parts
  UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < 160
), seeded AS (
  SELECT d.*, rate, unnest(range(n_parts)) AS part FROM documents d JOIN parts s ON d.source IS NOT DISTINCT FROM s.source
), units AS (
  SELECT *, ('0x' || substr(md5(CASE part WHEN 0 THEN 'mix-1:count:' ELSE 'mix-1:part:' || part || ':' END || coalesce(doc_id::VARCHAR, '~')), 1, 13))::BIGINT
    / 4503599627370496.0::DOUBLE AS u FROM seeded
), counts AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.rate, count(*) AS k
  FROM units d JOIN cdf t ON d.source IS NOT DISTINCT FROM t.source AND t.c <= d.u GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, round(rate, 9) AS rate,
  md5('mix-1:order:' || coalesce(doc_id::VARCHAR, '~') || ':' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(k)) AS copy FROM counts)""",
}
