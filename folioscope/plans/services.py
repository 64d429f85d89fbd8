"""Composite services: index build, retrieval, and answers for a batch of questions as one plan."""

from __future__ import annotations

from dataclasses import dataclass
from threading import Timer
from typing import Any
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import urls as U
from folioscope.functions.rules import Rules
from folioscope.operators import guardrails, hybrid, intent, keyword, requests, resolve, vectors
from folioscope.plans import segments
from folioscope.plans.segments import MODEL, Index
from folioscope.sources import scratch, tables


def pages_to_chunks(pages: DataFrame, id_col: str, html_col: str, most: int | None = None) -> DataFrame:
    """Pages to Markdown (of at most so many characters; None: whole) to chunks."""
    from folioscope.operators import chunking, html

    return chunking.sliding_chunks(html.html_to_markdown(pages, id_col, html_col, most), id_col, "markdown")


def build_indexes(spark: SparkSession, chunks: DataFrame, root: str, stamp: str, config: dict[str, Any] | None = None, normalized: bool = False) -> str:
    """Write chunks, posting blocks and vector cells of a new version, check that counts agree, and point to it last. normalized: NFKC was applied to the texts."""
    return segments.create(spark, chunks, root, tables.version_id(stamp, MODEL, config or {}), MODEL, normalized).manifest["version"]


load_index = segments.load


def page_chunks(pages: DataFrame, scheme: str | None = None) -> DataFrame:
    """Chunks of pages(url, html) as an index takes them; ids are made of the url's hash, so a page's chunks have ids of their own."""
    numbered = scratch.written(pages.select("url", F.xxhash64("url").alias("page"), "html"), "fetched")
    cut = pages_to_chunks(numbered, "page", "html").join(numbered.select(F.col("page").alias("id"), "url"), "id")
    return cut.select("chunk_id", "text", F.col("url").alias("source_url"), F.lit(scheme).cast("string").alias("scheme"), "section_title")


def reingest_url(spark: SparkSession, root: str, url: str, hosts: str, scheme: str | None = None, **options: str) -> Index:
    """One url from fetch to index: fetched within the allowed hosts, made to chunks, and put in place of what the index had of it, as a segment of its own.

    A page that can't be fetched leaves the index as it is and is an error; one without text is taken out. options: those of the page source.
    """
    from folioscope.sources.http import PageSource

    spark.dataSource.register(PageSource)
    page = scratch.written(spark.read.format("pages").options(urls=url, hosts=hosts, **options).load(), "page")
    got = page.select("status", "error").first()
    if got.error or got.status != 200:
        raise RuntimeError(f"{url}: {got.error or got.status}")
    chunks = page_chunks(page.select("url", F.decode("body", "UTF-8").alias("html")), scheme)
    return segments.reingest(spark, root, chunks, url)


def index_issues(spark: SparkSession, root: str, allowed: DataFrame | None = None, expected_version: str | None = None, scanned: int | None = None) -> DataFrame:
    """(code, n): what is wrong with the active version: another version than expected, no chunks, counts of chunks or vectors that differ from the manifest's, and
    source URLs that are not allowed. scanned: hold only indexes of up to so many chunks against the allowlist (None: all). Counts are aggregates of the written tables.
    """
    index = load_index(spark, root)
    active = index.manifest
    vectors = index._read("packs").select("segment", F.explode("ids").alias("id"))
    counts = index.chunks.agg(F.count("*").alias("chunks")).crossJoin(F.broadcast(index.living(vectors, "id").agg(F.count("*").alias("vectors"))))
    pointed = F.lit(active["chunks"])
    tests = [
        ("version_mismatch", F.lit(expected_version not in (None, active["version"])).cast("long")), ("empty_index", (F.col("chunks") == 0).cast("long")),
        ("chunk_count_mismatch", F.abs(F.col("chunks") - pointed)), ("vector_count_mismatch", F.abs(F.col("vectors") - pointed)),
    ]
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("code"), n.alias("n")) for c, n in tests])).alias("x")).select("x.*")
    if allowed is not None and (scanned is None or active["chunks"] <= scanned):
        off = U.keep_allowed(index.chunks.where(F.trim(F.coalesce("source_url", F.lit(""))) != ""), "source_url", allowed, negate=True)
        rows = rows.unionByName(off.agg(F.lit("url_not_allowlisted").alias("code"), F.count("*").alias("n")).select("code", "n"))
    return rows.where("n > 0")


@dataclass(frozen=True)
class Service:
    """What answers need. registry: the schemes, as a short list or as a table (see resolve.registry_index); chunks: (chunk_id, text, scheme, source_url, section_title, effective_date)."""

    rules: Rules
    policy: guardrails.Policy
    registry: list[resolve.Scheme] | DataFrame
    aliases: dict[str, str]
    k: int = 5
    pool: int = 12

    def retrieve(self, questions: DataFrame, chunks: DataFrame | None = None, index: Index | None = None) -> DataFrame:
        """Per question (query_id, query): decision of the intent, resolved scheme, and for those that are retrieved the best chunk with its score and status.

        With an index only its postings and vectors of the questions' terms are read; without one, chunks are tokenised and embedded for this call.
        """
        if index is not None:
            chunks = index.chunks
        asked = intent.classify(questions, "query", self.rules)
        solved = self._resolved(questions)
        # written at the points that several branches read: the rules are evaluated once, and the plans stay small
        asked = scratch.written(asked.join(solved.withColumnRenamed("confidence", "scheme_confidence"), "query_id"), "asked")
        live = asked.where(F.col("action").isin("retrieve", "performance_limited"))
        sure = (F.col("status") == "resolved") & (F.col("scheme_confidence") >= 0.82)
        live = live.withColumn("scheme_filter", F.when(sure, F.col("scheme")))
        if index is None:
            filtered = chunks.withColumn("scheme_filter", F.col("scheme"))
            found = keyword.bm25_topk(filtered, live, self.k, "chunk_id", "text", "query_id", "query", keep=["scheme_filter"])
        else:
            found = index.keyword_topk(keyword.query_terms(live, "query_id", "query"), self.k, live.select("query_id", F.col("scheme_filter").alias("scope")))
        near = self._near(live, chunks, index)
        fused = hybrid.fuse(hybrid.merge_channels(found, near), self.pool)
        rows = fused.drop("rank").join(chunks.withColumnRenamed("chunk_id", "id").withColumnRenamed("text", "chunk_text").withColumnRenamed("scheme", "chunk_scheme"), "id")
        facts = live.select("query_id", "query", "facet", F.col("scheme").alias("wanted"), F.col("scheme_filter").isNotNull().alias("sure"), "scheme_confidence", F.col("source_url").alias("resolved_url"))
        rows = rows.join(facts, "query_id")
        ranked = hybrid.rerank(rows, F.col("query"), F.col("chunk_text"), F.col("facet"), F.col("sure") & (F.col("chunk_scheme") == F.col("wanted")), F.col("effective_date"), self.rules.facets)
        best = ranked.where("rank = 1").withColumn("cite", hybrid.pick_citation(F.col("sure"), F.col("resolved_url"), F.col("scheme_confidence"), U.canonical(F.col("source_url"), self.rules.site), self.policy.default_url))
        best = best.select("query_id", "id", "chunk_text", "section_title", "effective_date", F.col("cite.url").alias("citation_url"), "final_score", F.col("status").alias("retrieval_status"))
        return asked.drop("status").join(best, "query_id", "left")

    def _resolved(self, questions: DataFrame) -> DataFrame:
        site = f"{self.rules.site}/"
        if isinstance(self.registry, list):
            return resolve.resolve(questions, "query_id", "query", self.registry, self.aliases, self.rules.house, site, self.policy.default_url)
        aliases = questions.sparkSession.createDataFrame(list(self.aliases.items()), "phrase string, scheme string")
        return resolve.resolve_registry(questions, "query_id", "query", self.registry, aliases, self.rules.house, site, self.policy.default_url)

    def _near(self, live: DataFrame, chunks: DataFrame, index: Index | None) -> DataFrame:
        """The vector channel: cells of the index, or one scan of the chunks for the questions of any scheme and one for those of their own."""
        asked = vectors.dense(vectors.hash_embedding(live, "query_id", "query", MODEL)).withColumnRenamed("id", "query_id")
        asked = asked.join(live.select("query_id", F.col("scheme_filter").alias("scope")), "query_id")
        if index is not None:
            return index.vector_topk(asked, self.k)
        held = vectors.dense(vectors.hash_embedding(chunks, "chunk_id", "text", MODEL)).join(chunks.select(F.col("chunk_id").alias("id"), F.col("scheme").alias("scope")), "id")
        held, asked = scratch.written(held, "vectors"), scratch.written(asked, "questions")
        every = vectors.cosine_topk(held, asked.where("scope IS NULL"), self.k, "id", "v", "query_id", "v")
        return every.union(vectors.cosine_topk(held, asked.where("scope IS NOT NULL"), self.k, "id", "v", "query_id", "v", key="scope"))

    def answer_within(self, questions: DataFrame, seconds: float, chunks: DataFrame | None = None, index: Index | None = None) -> DataFrame:
        """answer, written, with code and status null and 200; or, where that takes longer, a row for each question with upstream_timeout and its status. Jobs that are late are cancelled."""
        sc, group = questions.sparkSession.sparkContext, f"answer-{uuid4().hex}"
        late: list[bool] = []

        def cancel() -> None:
            late.append(True)
            sc._jsc.sc().cancelJobGroupAndFutureJobs(group)  # also what has not begun yet

        timer = Timer(seconds, cancel)
        sc.setJobGroup(group, "answers", interruptOnCancel=True)
        timer.start()
        try:
            done = scratch.written(self.answer(questions, chunks, index), "answers")
            return done.withColumns({"code": F.lit(None).cast("string"), "status": F.lit(200)})
        except Exception:  # a cancelled job ends in one of several kinds of error
            if not late:
                raise
            sc.setLocalProperty("spark.jobGroup.id", None)
            return questions.select("query_id", F.lit("upstream_timeout").alias("code"), F.lit(requests.STATUS["upstream_timeout"]).alias("status"))
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)

    def answer(self, questions: DataFrame, chunks: DataFrame | None = None, index: Index | None = None) -> DataFrame:
        """Envelopes for all questions: refused, abstained or composed, then validated and repaired."""
        got = scratch.written(self.retrieve(questions, chunks, index), "retrieved")
        refused = F.col("action").isin("refuse", "disambiguate")
        rows = got.withColumns({
            "outcome_type": F.when(refused, "refusal").otherwise("retrieval"), "refusal_type": intent.refusal_type(F.col("intent"), F.col("action")),
            "performance_limited": F.col("action") == "performance_limited", "retrieval_status": F.coalesce("retrieval_status", F.lit("not_found_in_sources")), "not_found_reason": F.lit(""),
            "citation_url": F.coalesce("citation_url", F.lit(self.policy.default_url)),
        })
        routed = scratch.written(guardrails.route(rows), "routed")
        parts = [
            guardrails.compose_factual(routed.where("route = 'factual'"), self.policy).drop("facet_detected"),
            guardrails.compose_refusal(routed.where("route = 'refusal'"), self.policy),
            guardrails.compose_refusal(routed.where("route = 'abstention'"), self.policy, abstain=True),
        ]
        drafts = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
        done = guardrails.validate_and_repair(scratch.written(drafts, "drafts"), self.policy)
        return done.select("query_id", "answer_type", "body_text", "citation_url", "citation_markdown", "disclaimer_line", "footer_line", "footer_date", "refusal_type", "passed", "repair_actions", guardrails.display_text(self.policy).alias("display"))
