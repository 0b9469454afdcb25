"""The registered queries and, for each, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ranking as R
from ..functions import text as X
from ..functions import vector as V
from ..operators import documents, metrics, models, parity, rag, search
from ..sources import catalogue, extract, sse, store, watermark
from ..sources.shared import materialize, new_path
from ..streaming import answers, ingest
from . import staging as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def registered(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql if sql.lstrip().startswith("WITH RECURSIVE") or "@" not in sql else "WITH " + S.SQL + sql.replace("@", "")
        return f

    return put


def six(c, name: str):
    return F.round(c, 6).alias(name)


as_of = lambda: F.to_timestamp(F.lit(S.AS_OF))
day = lambda c: F.date_format(c, "yyyy-MM-dd")


@registered("@SELECT raw_name AS name, description, license || '| ' AS licenses, CAST(projects.sourcerank AS BIGINT) AS sourcerank, deps AS dependents, strftime(projects.ts, '%Y-%m-%d') AS released, coalesce(stars_count, 0) AS stars, projects.keywords FROM projects LEFT JOIN repo ON key = id WHERE platform = 'Pypi' AND description IS NOT NULL AND trim(description) <> '' AND length(description) > 5 AND projects.ts > TIMESTAMP '1970-01-01'")
def extract_left_join(spark, d):
    rows = extract.extract(S.projects(spark, d), S.repositories(spark, d))
    return rows.select("name", "description", F.array_join("licenses", "|").alias("licenses"), "sourcerank", F.col("dependent_projects_count").alias("dependents"), day("latest_release_publish_timestamp").alias("released"), F.col("repository_stars_count").alias("stars"), "keywords")


@registered("@SELECT count(*) AS n FROM projects WHERE platform = 'Pypi' AND description IS NOT NULL AND trim(description) <> '' AND length(description) > 5 AND ts > TIMESTAMP '1998-01-01'")
def extract_count(spark, d):
    return extract.count_extract(S.projects(spark, d), S.SINCE)


@registered("@SELECT name, summary, stars, strftime(ts, '%Y-%m-%d') AS released FROM pkg")
def incremental_since_watermark(spark, d):
    return S.packages(spark, d).select("name", "summary", "stars", day("latest_release").alias("released"))


@registered("SELECT p_partkey AS id, replace(lower(trim('  Foo_Bar_' || p_partkey || ' ')), '_', '-') AS name FROM part")
def normalize_names(spark, d):
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.normalize_name(F.concat(F.lit("  Foo_Bar_"), F.col("p_partkey").cast("string"), F.lit(" "))).alias("name"))


@registered("SELECT p_partkey AS id, len(list_filter(list_transform(string_split(replace(replace(p_name, ' ', ' ; ') || ',, ', ';', ','), ','), lambda x: trim(x)), lambda x: x <> '')) AS n, array_to_string(list_filter(list_transform(string_split(replace(replace(p_name, ' ', ' ; ') || ',, ', ';', ','), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS keywords FROM part")
def keyword_list(spark, d):
    items = X.text_list(F.concat(F.replace("p_name", F.lit(" "), F.lit(" ; ")), F.lit(",, ")))
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.size(items).cast("bigint").alias("n"), F.array_join(items, "|").alias("keywords"))


@registered("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand || ', ' || p_type END AS license FROM part")
def license_join(spark, d):
    items = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit(" "), F.lit(""))).otherwise(F.array(F.col("p_brand"), F.lit(" "), F.concat(F.lit(" "), F.col("p_type"))))
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.license_text(X.array_list(items)).alias("license"))


@registered("@SELECT name, document FROM doc")
def search_document(spark, d):
    return S.packages(spark, d).select("name", "document")


@registered("@SELECT name, sha256(document) AS content_hash FROM doc")
def content_hash(spark, d):
    return S.packages(spark, d).select("name", "content_hash")


_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (('0x' || substr(h, 17, 1))::INT % 4), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@registered(f"SELECT name, {_UUID} AS point_id FROM (SELECT 'part-' || p_partkey AS name, sha1(from_hex('{X.NAMESPACE_DNS}') || encode('pypi:part-' || p_partkey)) AS h FROM part)")
def point_id_uuid5(spark, d):
    name = F.concat(F.lit("part-"), F.col("p_partkey").cast("string"))
    return S.table(spark, d, "part").select(name.alias("name"), X.point_id(name).alias("point_id"))


@registered("SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def dedup_last_wins(spark, d):
    return store.last_wins(S.table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", six(F.col("value"), "value"))


@registered("SELECT * FROM (SELECT c_custkey AS id, c_name AS name, round(c_acctbal, 2) AS value FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 <> 0) UNION ALL SELECT c_custkey, upper(c_name), round(c_acctbal * 2, 2) FROM customer WHERE c_custkey % 6 = 0 UNION ALL SELECT -c_custkey, c_name, 0.0 FROM customer WHERE c_custkey % 100 = 1")
def upsert_merge(spark, d):
    c = S.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.round("c_acctbal", 2).alias("value"))
    new = S.table(spark, d, "customer").where("c_custkey % 6 = 0").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("name"), F.round(F.col("c_acctbal") * 2, 2).alias("value"))
    more = c.where("id % 100 = 1").select((-F.col("id")).alias("id"), "name", F.lit(0.0).alias("value"))
    return store.merge(c, new.unionByName(more), ["id"])


@registered("SELECT event_type, strftime(max(ts), '%Y-%m-%d') AS watermark, count(*) AS processed FROM events GROUP BY 1")
def max_watermark(spark, d):
    return ingest.progress(S.table(spark, d, "events"), "ts", "event_type").select("event_type", day("newest").alias("watermark"), F.col("n").alias("processed"))


@registered("SELECT vec_id AS id, round(list_sum(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))), 5) AS total, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS e FROM embeddings)")
def l2_normalize(spark, d):
    e = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), V.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("u"))
    return e.select("id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), six(F.element_at("u", 1), "first"))


@registered("""SELECT g, round(list_sum(list_transform(m, lambda x: x / n)), 5) AS total, round(m[1] / n, 6) AS first, round(m[-1] / n, 6) AS last FROM (SELECT g, m, sqrt(list_dot_product(m, m)) AS n FROM (
  SELECT g, list(s ORDER BY i) AS m FROM (SELECT vec_id // 10 AS g, i, sum(e) FILTER (vec_id % 10 < 7) / 7.0 AS s FROM (
    SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1))""")
def mean_pool(spark, d):
    """Ten vectors as the tokens of a text, seven of them under the mask."""
    e = S.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("g"), F.struct("vec_id", F.col("embedding").alias("h"), F.when(F.col("vec_id") % 10 < 7, 1).otherwise(0).alias("m")).alias("t"))
    tokens = e.groupBy("g").agg(F.array_sort(F.collect_list("t")).alias("t"))
    p = tokens.withColumn("p", V.pool(F.col("t.h"), F.col("t.m"), "mean"))
    return p.select("g", F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), six(F.element_at("p", 1), "first"), six(F.element_at("p", -1), "last"))


@registered("SELECT g, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first, round(e[-1] / sqrt(list_dot_product(e, e)), 6) AS last FROM (SELECT vec_id // 10 AS g, list_transform(embedding, lambda x: x::DOUBLE * 2) AS e FROM embeddings WHERE vec_id % 10 = 0)")
def cls_pool(spark, d):
    e = S.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("g"), F.struct("vec_id", F.transform("embedding", lambda x: x.cast("double") * 2).alias("h")).alias("t"))
    tokens = e.groupBy("g").agg(F.array_sort(F.collect_list("t")).alias("t"))
    p = tokens.withColumn("p", V.pool(F.col("t.h"), F.lit(None), "cls"))
    return p.select("g", six(F.element_at("p", 1), "first"), six(F.element_at("p", -1), "last"))


@registered("SELECT a.vec_id AS id, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE * 5), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    e = S.table(spark, d, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(after, "vec_id").select(F.col("vec_id").alias("id"), six(V.cosine(F.transform("embedding", lambda x: x.cast("double") * 5), F.col("b")), "cosine"))


@registered("@SELECT qid, key AS id, rank, round(score, 6) AS score FROM knn WHERE rank <= 50")
def cosine_topk(spark, d):
    return search.nearest(S.query_vectors(spark, d), S.stored_corpus(spark, d)).select("qid", "id", F.col("rank").cast("bigint").alias("rank"), six(F.col("score"), "score"))


@registered("@SELECT qid, key AS id, rank, round(score, 6) AS score FROM knn WHERE rank <= 10")
def cosine_topk_multi(spark, d):
    return search.nearest(S.query_vectors(spark, d), S.stored_corpus(spark, d), 10).select("qid", "id", F.col("rank").cast("bigint").alias("rank"), six(F.col("score"), "score"))


@registered("SELECT qid, id, rank, round(score, 6) AS score FROM (SELECT a.vec_id AS qid, b.vec_id AS id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= 10")
def blocked_topk(spark, d):
    e = S.table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return search.nearest(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 10).select("qid", "id", F.col("rank").cast("bigint").alias("rank"), six(F.col("score"), "score"))


@registered("@SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank, round(s, 6) AS score FROM (SELECT qid, corpus.key AS id, score AS s FROM scored JOIN corpus USING (key) WHERE stars >= 30 AND license = 'Brand#12') QUALIFY rank <= 10")
def filtered_topk(spark, d):
    where = search.payload_filter(min_stars=30, license="Brand#12", requires_python="", active_within_days=30)
    return search.nearest(S.query_vectors(spark, d), S.stored_corpus(spark, d), 10, where).select("qid", "id", F.col("rank").cast("bigint").alias("rank"), six(F.col("score"), "score"))


@registered("SELECT p_partkey AS id, round(CASE WHEN p_size - 20 > 0 THEN ln(1 + p_size - 20) ELSE 0 END, 6) AS value FROM part")
def log_popularity(spark, d):
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), six(R.log_count(F.col("p_size") - 20), "value"))


@registered("""SELECT id, round(least(CASE WHEN sr <> 0 THEN 0.85 * b + 0.15 * CASE WHEN sr > 0 THEN ln(1 + sr) ELSE 0 END ELSE b END / 11.5, 1), 6) AS value FROM (
  SELECT id, sr, CASE WHEN dl IS NOT NULL THEN 0.5 * l + 0.5 * ln(1 + dl) WHEN dep <> 0 THEN 0.6 * l + 0.4 * ln(1 + dep) ELSE l END AS b FROM (
    SELECT p_partkey AS id, ln(1 + p_size * 1000) AS l, CASE WHEN p_partkey % 4 = 0 THEN (p_partkey % 3) * 1000000 END AS dl, p_partkey % 5 AS dep, p_partkey % 9 - 3 AS sr FROM part))""")
def popularity_blend(spark, d):
    k = F.col("p_partkey")
    return S.table(spark, d, "part").select(k.alias("id"), six(R.popularity(F.col("p_size") * 1000, F.when(k % 4 == 0, (k % 3) * 1_000_000), k % 5, k % 9 - 3), "value"))


@registered("SELECT l_orderkey AS id, l_linenumber AS line, round(exp(-greatest(epoch_us(TIMESTAMP '2000-01-01') - epoch_us(l_shipdate), 0) / 86400000000.0 / 180.0), 6) AS value FROM lineitem")
def recency_decay(spark, d):
    value = R.recency(F.col("l_shipdate").cast("timestamp"), F.to_timestamp(F.lit("2000-01-01")))
    return S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), six(value, "value"))


def _search(spark, d, **options):
    return search.search(S.query_vectors(spark, d), S.stored_corpus(spark, d), as_of(), **options)


@registered("@SELECT qid, key AS id, place, rank, round(score, 6) AS score, round(final, 6) AS final FROM top WHERE place <= 10")
def blend_search(spark, d):
    found = _search(spark, d)
    return found.select("qid", "id", F.col("place").cast("bigint").alias("place"), F.col("rank").cast("bigint").alias("rank"), six(F.col("score"), "score"), six(F.col("final"), "final"))


@registered("SELECT o_custkey AS qid, o_orderkey AS id, round(CASE WHEN hi > lo THEN (o_totalprice - lo) / (hi - lo) ELSE 1.0 END, 6) AS score FROM (SELECT *, min(o_totalprice) OVER w AS lo, max(o_totalprice) OVER w AS hi FROM orders WINDOW w AS (PARTITION BY o_custkey))")
def minmax_rerank(spark, d):
    return S.table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), six(R.min_max(F.col("o_totalprice"), "o_custkey"), "score"))


@registered("""@SELECT qid, key AS id, place, round(relevance, 6) AS relevance, round(final, 6) AS final FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, rank) AS place FROM (
    SELECT r.*, 0.75 * relevance + 0.15 * CASE WHEN sr <> 0 THEN pop ELSE pop0 END + 0.10 * rec AS final FROM (
      SELECT *, CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 1.0 END AS relevance FROM (
        SELECT *, min(s) OVER (PARTITION BY qid) AS lo, max(s) OVER (PARTITION BY qid) AS hi FROM (
          SELECT knn.qid, knn.key, knn.rank, CAST((knn.key * 7919 + knn.qid) % 101 AS DOUBLE) AS s FROM knn WHERE rank <= 20))) r JOIN algebra USING (key)))""")
def rerank_search(spark, d):
    """limit 50 with reranking gives 20 rows a query; the scorer is a fixed function of the ids."""
    scorer = lambda c: c.withColumn("rerank_score", ((F.col("id") * 7919 + F.col("qid")) % 101).cast("double"))
    found = _search(spark, d, limit=50, use_rerank=True, scorer=scorer)
    return found.select("qid", "id", F.col("place").cast("bigint").alias("place"), six(F.col("relevance"), "relevance"), six(F.col("final"), "final"))


def _hits(spark, d):
    found = _search(spark, d, limit=8)
    return search.hits(found, ["license", "sourcerank"])


@registered("@SELECT qid, place, name, summary, round(final, 6) AS score, stars, 'https://pypi.org/project/' || name || '/' AS pypi_url, count(*) OVER (PARTITION BY qid) AS total, every.license AS license FROM top JOIN every USING (key) WHERE place <= 8")
def hit_projection(spark, d):
    h = _hits(spark, d)
    return h.select("qid", F.col("place").cast("bigint").alias("place"), "name", "summary", six(F.col("score"), "score"), "stars", "pypi_url", F.col("total").cast("bigint").alias("total"), F.element_at("metadata", "license").alias("license"))


_CONTEXT = "string_agg(place || '. name: ' || name || chr(10) || '   description: ' || summary, chr(10) ORDER BY place)"


@registered(f"@SELECT qid, {_CONTEXT} AS context FROM top JOIN every USING (key) WHERE place <= 8 GROUP BY qid")
def rag_context(spark, d):
    return rag.context(_hits(spark, d))


_HEAD = rag.INSTRUCTIONS.replace("'", "''").replace("@", "")


@registered(f"@SELECT qid, '{_HEAD}' || chr(10) || 'User query:' || chr(10) || 'part ' || qid || chr(10) || chr(10) || 'Candidate packages (name and description only):' || chr(10) || {_CONTEXT} || chr(10) AS prompt FROM top JOIN every USING (key) WHERE place <= 8 GROUP BY qid")
def rag_prompt(spark, d):
    return rag.prompts(S.query_vectors(spark, d), _hits(spark, d))


def _answers(hits):
    """Answers that name the first hit in another spelling, one that does not exist, and the third hit."""
    h = hits.where("place IN (1, 3)").groupBy("qid").agg(F.max(F.when(F.col("place") == 1, F.struct("name", "summary"))).alias("a"), F.max(F.when(F.col("place") == 3, F.struct("name", "summary"))).alias("b"))
    rec = lambda name, snippet: F.struct(name.alias("package"), F.lit(" fits ").alias("reason"), snippet.alias("cited_snippet"))
    body = F.to_json(F.struct(F.array(rec(F.upper("a.name"), F.upper(F.substring("a.summary", 1, 8))), rec(F.concat(F.lit("ghost-"), F.col("qid").cast("string")), F.lit("x")), rec(F.col("b.name"), F.lit("not there"))).alias("recommendations")))
    return h.select("qid", F.when(F.floor(F.col("qid") / 20) % 5 == 4, F.lit("not json")).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```"))).alias("raw"))


@registered("@SELECT qid, CASE place WHEN 1 THEN 0 ELSE 2 END AS pos, name AS package, 'fits' AS reason, place = 1 AS found FROM top JOIN every USING (key) WHERE place IN (1, 3) AND qid // 20 % 5 <> 4")
def validate_grounded(spark, d):
    h = materialize(_hits(spark, d), "hits")
    return rag.grounded(_answers(h), h).select("qid", "pos", "package", "reason", F.col("snippet_in_description").alias("found"))


@registered("@SELECT qid, 1 AS pos, 'ghost-' || qid AS name FROM top WHERE place = 1 AND qid // 20 % 5 <> 4")
def validate_dropped(spark, d):
    h = materialize(_hits(spark, d), "hits")
    return rag.dropped(_answers(h), h)


@registered("""@SELECT qid, CASE WHEN qid // 20 % 5 = 4 THEN 'not JSON' END AS parse_error, CASE WHEN qid // 20 % 5 = 4 THEN '' ELSE string_agg(name, '|' ORDER BY place) END AS packages,
  CASE WHEN qid // 20 % 5 = 4 THEN '' ELSE 'ghost-' || qid END AS dropped FROM top JOIN every USING (key) WHERE place IN (1, 3) GROUP BY qid""")
def grounded_results(spark, d):
    """One row an answer: at most three recommendations, and what was dropped."""
    h = materialize(_hits(spark, d), "hits")
    return rag.results(_answers(h), h).select("qid", "parse_error", F.array_join("recommendations.package", "|").alias("packages"), F.array_join("dropped", "|").alias("dropped"))


@registered("@SELECT qid, CASE WHEN qid // 20 % 5 = 4 THEN 'not JSON' END AS parse_error, CAST(CASE WHEN qid // 20 % 5 = 4 THEN 0 ELSE 3 END AS BIGINT) AS n FROM top WHERE place = 1")
def parse_answers(spark, d):
    return rag.parse_answers(_answers(_hits(spark, d))).select("qid", "parse_error", F.size("recommendations").cast("bigint").alias("n"))


@registered("SELECT doc_id, n_chars > 60 AND contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), lower(trim(regexp_replace(substr(text, 11, 40), '\\s+', ' ', 'g')))) AS found FROM documents")
def snippet_check(spark, d):
    docs = S.table(spark, d, "documents")
    return docs.select("doc_id", ((F.col("n_chars") > 60) & X.in_text(F.upper(F.substring("text", 11, 40)), F.col("text"))).alias("found"))


@registered("SELECT event_id, 'event: ' || event_type || chr(10) || 'data: ' || '{\"id\":' || event_id || '}' || chr(10) || chr(10) AS frame FROM events")
def sse_format(spark, d):
    return S.table(spark, d, "events").select("event_id", sse.frame(F.col("event_type"), F.to_json(F.struct(F.col("event_id").alias("id")))).alias("frame"))


@registered("SELECT user_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS seq, event_type AS event, CAST(event_id AS VARCHAR) AS data FROM events")
def sse_parse(spark, d):
    e = S.table(spark, d, "events").withColumn("f", sse.frame(F.col("event_type"), F.col("event_id").cast("string")))
    buffers = e.groupBy(F.col("user_id").alias("id")).agg(F.concat(F.lit(": comment\n\n"), F.array_join(F.array_sort(F.collect_list(F.struct("event_id", "f"))).getField("f"), ""), F.lit("event: partial\ndata: 1")).alias("buffer"))
    return sse.parse(buffers)


@registered("SELECT user_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS seq, event_type AS event, event_id || ' ' AS data FROM events")
def sse_parse_browser(spark, d):
    """The reading of a browser: comments don't hide what follows in their block, and data keeps the spaces at its end."""
    f = F.concat(F.lit(": a comment\nevent:  "), F.col("event_type"), F.lit(" \ndata:   "), F.col("event_id").cast("string"), F.lit(" \n\n"))
    e = S.table(spark, d, "events").select(F.col("user_id").alias("id"), "event_id", f.alias("f"))
    return sse.parse(e.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("event_id", "f"))).getField("f"), "").alias("buffer")), dialect="browser")


@registered("""SELECT conv_id AS id, turn_no AS n, 'llm_delta' AS event, '"' || role || ' ' || length(coalesce(text, '')) || ' é"' AS data FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_no FROM conversations)
  UNION ALL SELECT conv_id, count(*), CASE WHEN conv_id % 5 = 0 THEN 'llm_error' ELSE 'llm_done' END, CASE WHEN conv_id % 5 = 0 THEN '{"message": "no answer within 3 s"}' ELSE '1' END FROM conversations GROUP BY conv_id""")
def answer_stream(spark, d):
    """Conversations as streams of events, cut into pieces at any byte; one in five falls silent and is ended by the clock."""
    talk = S.table(spark, d, "conversations").withColumn("f", sse.frame(F.lit("llm_delta"), F.concat(F.lit('"'), "role", F.lit(" "), F.coalesce(F.length("text"), F.lit(0)).cast("string"), F.lit(' é"'))))
    ends = F.when(F.col("conv_id") % 5 == 0, "event: llm_done\ndata:").otherwise("event: llm_done\ndata: 1\n\n")
    whole = talk.groupBy(F.col("conv_id").alias("id")).agg(F.encode(F.concat(F.array_join(F.array_sort(F.collect_list(F.struct("turn", "f"))).getField("f"), ""), F.any_value(ends)), "utf-8").alias("bytes"))
    size = F.lit(7) + F.col("id") % 50
    cut = whole.select("id", "bytes", size.alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length("bytes") - 1) / size))).alias("seq"))
    pieces = cut.select("id", "seq", F.substring("bytes", (F.col("seq") * F.col("size") + 1).cast("int"), F.col("size").cast("int")).alias("piece"))
    # A stream is in one file here, so that only what is silent is waited for, however slow the machines are.
    pieces.repartition(4, "id").write.parquet(f"{(root := new_path(spark, 'pieces'))}/in")
    return answers.ended(spark, f"{root}/in", pieces.schema, f"{root}/out", f"{root}/checkpoint", silent_ms=3_000, files_per_batch=4)


@registered("""SELECT user_id AS id, arg_max(CAST(event_id AS VARCHAR), event_id) FILTER (event_id % 4 = 0) AS ranked_list, '[' || max(event_id) FILTER (event_id % 4 = 1) || ']' AS recommendations,
  arg_max('["' || event_type || '"]', event_id) FILTER (event_id % 4 = 1) AS dropped, arg_max(CASE WHEN event_id % 3 = 0 THEN 'Generation failed.' ELSE 'e' || event_id END, event_id) FILTER (event_id % 4 = 2) AS error FROM events GROUP BY 1""")
def sse_collapse(spark, d):
    """Events of every kind, the last of each counts; an error without words gets the fixed ones."""
    n = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("ranked_list", "llm_done", "llm_error", "llm_delta")]), (n % 4 + 1).cast("int"))
    data = F.when(n % 4 == 1, F.to_json(F.struct(F.array(n).alias("recommendations"), F.array("event_type").alias("dropped"))))
    data = data.when(n % 4 == 2, F.to_json(F.struct(F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("e"), n.cast("string"))).alias("message")))).otherwise(n.cast("string"))
    return sse.collapse(S.table(spark, d, "events").select(F.col("user_id").alias("id"), n.alias("seq"), kind.alias("event"), data.alias("data")))


@registered("SELECT p_partkey AS id, round(CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 1 / (1 + exp(p_size - 25.0)) END, 6) AS score FROM part")
def logits_to_scores(spark, d):
    logits = F.when(F.col("p_partkey") % 2 == 0, F.array(F.col("p_size").cast("float"))).otherwise(F.array(F.col("p_size").cast("float"), F.lit(25.0).cast("float")))
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), six(V.logits_score(logits), "score"))


@registered("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max FROM events WHERE event_id % 10 <> 0 GROUP BY 1")
def latency_percentiles(spark, d):
    e = S.table(spark, d, "events").withColumn("ok", F.col("event_id") % 10 != 0)
    return metrics.percentiles(e, "value", "event_type").select("event_type", "n", *[six(F.col(c), c) for c in ("p50", "p95", "p99", "max")])


@registered("SELECT event_type, count(*) FILTER (event_id % 10 <> 0) AS ok, count(*) AS total FROM events GROUP BY 1")
def success_ratio(spark, d):
    return metrics.success(S.table(spark, d, "events").withColumn("ok", F.col("event_id") % 10 != 0), "event_type")


@registered("SELECT doc_id, CASE WHEN length(t) > 100 THEN substr(t, 1, 97) || '...' ELSE t END AS line FROM (SELECT doc_id, replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS t FROM documents)")
def result_lines(spark, d):
    return S.table(spark, d, "documents").select("doc_id", X.shortened(F.col("text")).alias("line"))


@registered("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html FROM pages")
def escaped_html(spark, d):
    return S.table(spark, d, "pages").select("page_id", X.escape_html(F.col("html")).alias("html"))


@registered("SELECT conv_id AS qid, string_agg(text, '' ORDER BY turn) AS raw FROM conversations GROUP BY 1")
def token_concat(spark, d):
    return rag.joined_tokens(S.table(spark, d, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("seq"), "text"))


#: Lists of the index and how many are probed; the README has the recall with the share of pairs compared.
#: Lists of ann_topk's index that a query looks at, of 64, and codes of them that it compares in full.
PROBES, SHORT = 48, 40


@registered()
def ann_topk(spark, d):
    """Of the stored index, the nearest lists and the best codes only; tests/test_index.py holds recall and shares."""
    return S.stored_index(spark, d).approximate(S.query_vectors(spark, d), 10, PROBES, SHORT).select("qid", "id", F.col("rank").cast("bigint").alias("rank"), six(F.col("score"), "score"))


@registered()
def ann_shares(spark, d):
    """What ann_topk compares for each query, as shares of the index, and how much of the exact answer it finds."""
    index, asked = S.stored_index(spark, d), S.query_vectors(spark, d)
    found, blocks = index.candidates(asked, 10, PROBES, SHORT)
    got = index.ranked(index.products(found, blocks), 10).select("qid", "id", F.lit(1).alias("hit"))
    hits = index.exact(asked, 10).join(got, ["qid", "id"], "left").groupBy("qid").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
    work = index.work(asked, found, 10, PROBES)
    return work.join(hits, "qid").select("qid", (F.col("coded") / F.col("rows")).alias("coded"), (F.col("products") / F.col("rows")).alias("products"), "recall")


@registered("@SELECT qid, key AS id, rank, round(score, 6) AS score FROM knn WHERE rank <= 50")
def bounded_topk(spark, d):
    """Exact search by codes with proven bounds: full products only for what may still be among the nearest."""
    return S.stored_index(spark, d).exact(S.query_vectors(spark, d), 50).select("qid", "id", F.col("rank").cast("bigint").alias("rank"), six(F.col("score"), "score"))


@registered("""@SELECT qid, count(*) AS n, round(corr(a, b), 6) AS correlation, (SELECT count(*) FROM pairs x JOIN pairs y ON x.qid = p.qid AND y.qid = x.qid AND x.a < y.a AND x.b > y.b) AS inversions,
  corr(a, b) >= 0.99 AND (SELECT count(*) FROM pairs x JOIN pairs y ON x.qid = p.qid AND y.qid = x.qid AND x.a < y.a AND x.b > y.b) = 0 AS passed
  FROM (SELECT qid, round(score, 6) AS a, round(score, 6) + (key % 7) * 0.0004 * (qid % 40) AS b FROM knn WHERE rank <= 50) p GROUP BY qid""".replace("@SELECT", "@, pairs AS (SELECT qid, round(score, 6) AS a, round(score, 6) + (key % 7) * 0.0004 * (qid % 40) AS b FROM knn WHERE rank <= 50) SELECT"))
def parity_gate(spark, d):
    """Scores of the nearest and of a model that strays from them more and more, query by query."""
    a = F.round("score", 6)
    found = search.nearest(S.query_vectors(spark, d), S.stored_corpus(spark, d), 50).select("qid", a.alias("a"), (a + (F.col("id") % 7) * 0.0004 * (F.col("qid") % 40)).alias("b"))
    return parity.gate(found, "qid").select("qid", "n", six(F.col("correlation"), "correlation"), "inversions", "passed")


@registered("@SELECT raw_name AS name, description, license || '| ' AS licenses, CAST(projects.sourcerank AS BIGINT) AS sourcerank, deps AS dependents, strftime(projects.ts, '%Y-%m-%d') AS released, coalesce(stars_count, 0) AS stars, projects.keywords FROM projects LEFT JOIN repo ON key = id WHERE platform = 'Pypi' AND description IS NOT NULL AND trim(description) <> '' AND length(description) > 5 AND projects.ts > TIMESTAMP '1970-01-01'")
def extract_source(spark, d):
    """The extract out of a data source of its own, which takes over the platform and the watermark."""
    S.projects(spark, d).write.parquet(path := new_path(spark, "catalogue"))
    spark.dataSource.register(catalogue.CatalogueSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = extract.extract(spark.read.format("semlode_catalogue").option("project", "mine").load(path), S.repositories(spark, d))
    return rows.select("name", "description", F.array_join("licenses", "|").alias("licenses"), "sourcerank", F.col("dependent_projects_count").alias("dependents"), day("latest_release_publish_timestamp").alias("released"), F.col("repository_stars_count").alias("stars"), "keywords")


@registered()
def embed_rerank(spark, d):
    """Texts through the stand-in models: embed, search, rerank."""
    embed = models.hashed_embedder(64)
    # Dealt before it is embedded, however few files the tables have; written, as it is searched and joined.
    dealt = S.packages(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
    docs = materialize(embed(dealt, "document").withColumn("id", F.col("name")).drop("document"), "embedded")
    queries = embed(S.query_vectors(spark, d).select("qid", "query"), "query")
    found = search.search(queries, docs, as_of(), use_rerank=True, scorer=models.overlap_scorer)
    return found.select("qid", "id", "place", six(F.col("final"), "final"))


_POINT = f"(SELECT *, {_UUID} AS point_id FROM (SELECT *, sha1(from_hex('{X.NAMESPACE_DNS}') || encode('pypi:' || name)) AS h FROM doc))"


@registered(f"@SELECT point_id, name, sha256(document) AS content_hash, (SELECT strftime(max(ts), '%Y-%m-%d') FROM pkg) AS watermark, (SELECT count(*) FROM pkg) AS processed FROM {_POINT}")
def stream_upsert(spark, d):
    """Packages come as a stream of files and are upserted in micro-batches under a watermark; a second run of the stream finds nothing new."""
    root = new_path(spark, "stream")
    rows = S.packages(spark, d).drop("document")
    rows.repartition(3, "name").write.parquet(f"{root}/in")
    for _ in range(2):
        # The second run has a state of its own making only in the checkpoint.
        run = ingest.Ingest(store.Collection(spark, f"{root}/points", 16, most_deltas=2), models.hashed_embedder(16), f"{root}/last.txt")
        ingest.run_stream(spark, f"{root}/in", rows.schema, lambda s: s, run, f"{root}/checkpoint")
    saved = watermark.load(spark, f"{root}/last.txt")
    return run.collection.read().select("point_id", "payload.name", "payload.content_hash", F.lit(saved).alias("watermark"), F.lit(run.processed).cast("bigint").alias("processed"))


@registered(f"@SELECT point_id, name, 'new ' || summary AS summary FROM {_POINT} WHERE sourcerank % 3 = 0 UNION ALL SELECT point_id, name, summary FROM {_POINT} WHERE sourcerank % 3 <> 0")
def collection_upsert(spark, d):
    """A collection with a third of its rows replaced: read through base, deltas and a merge of both."""
    made = store.Collection(spark, new_path(spark, "points"), 4, most_deltas=2)
    packages = S.packages(spark, d).drop("document").withColumn("vector", F.array(*[F.lit(0.5)] * 4).cast("array<float>"))
    for part in (packages, packages.where("sourcerank % 3 = 0").withColumn("summary", F.lit("old")), packages.where("sourcerank % 3 = 0").withColumn("summary", F.concat(F.lit("new "), "summary"))):
        made.ensure()
        made.upsert(store.points(part))
    return made.read().select("point_id", "payload.name", "payload.summary")


@registered("@SELECT raw_name AS name, coalesce(stars_count, 0) AS stars FROM projects LEFT JOIN repo ON key = id WHERE platform = 'Pypi' AND description IS NOT NULL AND trim(description) <> '' AND length(description) > 5 AND projects.ts > TIMESTAMP '1998-01-01'")
def extract_by_name(spark, d):
    """The extract over catalogue tables, with names and values bound as parameters."""
    p = S.projects(spark, d)
    p.withColumns({c: F.lit(None).cast("string") for c in ("homepage_url", "repository_url", "language", "versions_count", "dependent_repositories_count")}).createOrReplaceTempView("semlode_projects")
    S.repositories(spark, d).createOrReplaceTempView("semlode_repositories")
    return extract.extract_tables(spark, "semlode_projects", "semlode_repositories", S.SINCE).select("name", F.col("repository_stars_count").alias("stars"))


@registered("SELECT event_id AS id, strftime(t, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(t) % 1000000 <> 0 THEN '.' || lpad(CAST(epoch_us(t) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00' AS iso FROM (SELECT event_id, date_trunc('second', ts) + to_microseconds(event_id % 3 * 1250) AS t FROM events)")
def iso_times(spark, d):
    t = F.timestamp_micros(F.unix_micros(F.date_trunc("second", F.col("ts").cast("timestamp"))) + F.col("event_id") % 3 * 1250)
    return S.table(spark, d, "events").select(F.col("event_id").alias("id"), X.iso_time(t).alias("iso"))


@registered("SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '2024-01-02 03:04:05' WHEN 1 THEN '2024-02-03 00:00:00' END AS time, CASE p_partkey % 5 WHEN 2 THEN '2024' WHEN 3 THEN 'soon' END AS raw FROM part")
def parsed_times(spark, d):
    """ISO date-times with Z, dates, bare years, other text and ''; what is not read is kept as text."""
    given = F.element_at(F.array(*[F.lit(x) for x in ("2024-01-02T03:04:05Z", "2024-02-03", "2024", "soon", "")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    t = S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.time_or_text(given).alias("t"))
    return t.select("id", F.date_format("t.time", "yyyy-MM-dd HH:mm:ss").alias("time"), F.col("t.raw").alias("raw"))


@registered("SELECT p_partkey AS id, CASE WHEN ms < 1000 THEN ms || ' ms' ELSE printf('%.2f s', ms / 1000.0) END AS shown, round_even(p_partkey / 8.0, 1) AS tenth FROM (SELECT p_partkey, p_partkey * 10 AS ms FROM part)")
def durations(spark, d):
    k = F.col("p_partkey")
    return S.table(spark, d, "part").select(k.alias("id"), X.duration(k * 10).alias("shown"), X.round_ms(k / 8.0).alias("tenth"))


@registered("@SELECT name, 23 AS keys, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS released, CAST(stars AS VARCHAR) AS stars, sha256(document) AS hash FROM doc")
def payload_json(spark, d):
    """The payload as JSON: every key, also those that are null, times as text."""
    p = S.packages(spark, d).select("name", documents.payload_json().alias("j"))
    get = lambda k: F.get_json_object("j", f"$.{k}")
    return p.select("name", F.size(F.json_object_keys("j")).alias("keys"), get("latest_release").alias("released"), get("stars").alias("stars"), get("content_hash").alias("hash"))


_MANY = "array_to_string(list_transform(range(1, least({most}, {n}) + 1), lambda i: '{word}' || i), ', ')"


@registered(f"""SELECT id, 'Package: p' || id || CASE WHEN id % 4 = 0 THEN '' WHEN id % 4 = 1 THEN chr(10) || 'Summary: ' ELSE chr(10) || 'Summary: about ' || id END
  || CASE WHEN id % 30 = 0 THEN '' ELSE chr(10) || 'Keywords: ' || {_MANY.format(most=20, n='id % 30', word='k')} END || CASE WHEN id % 20 = 0 THEN '' ELSE chr(10) || 'Dependencies: ' || {_MANY.format(most=15, n='id % 20', word='d')} END
  || CASE WHEN id % 13 = 0 THEN '' ELSE chr(10) || 'Category: ' || {_MANY.format(most=10, n='id % 13', word='c')} END AS document FROM (SELECT p_partkey AS id FROM part)""")
def document_sections(spark, d):
    """All five sections of a document, each also empty, and lists over their limits."""
    k = F.col("p_partkey")
    several = lambda n, word: F.transform(F.filter(F.sequence(F.lit(0), (k % n).cast("int")), lambda i: i > 0), lambda i: F.concat(F.lit(word), i.cast("string")))
    summary = F.when(k % 4 == 0, "").when(k % 4 == 1, "  ").otherwise(F.concat(F.lit(" about "), k.cast("string"), F.lit(" ")))
    rows = S.table(spark, d, "part").select(k.alias("id"), F.concat(F.lit("p"), k.cast("string")).alias("name"), summary.alias("summary"), several(30, "k").alias("keywords"), several(20, "d").alias("dependencies"), several(13, "c").alias("classifiers"))
    return rows.select("id", documents.search_document().alias("document"))


@registered("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END || CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 2 <> 0 THEN chr(10) ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_type END AS text FROM part")
def candidate_texts(spark, d):
    name, summary = F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")), F.when(F.col("p_partkey") % 2 != 0, F.concat(F.lit(" "), "p_type", F.lit("\n")))
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.regexp_replace(search.candidate_text(name, summary), "\n ", "\n").alias("text"))


@registered("""SELECT id, CASE WHEN id % 4 = 3 THEN 'raw' ELSE 'desc' END AS summary, CASE id % 3 WHEN 0 THEN 'a|b' WHEN 1 THEN '' ELSE 'x' END AS keywords, CASE WHEN id % 5 = 0 THEN 7 ELSE id % 5 END AS stars,
  CASE WHEN id % 2 = 0 THEN 'https://pypi.org/project/n-' || id || '/' ELSE 'u' END AS url, CASE WHEN id % 6 = 0 THEN 'Pypi' ELSE 'Other' END AS platform FROM (SELECT p_partkey AS id FROM part)""")
def row_fallbacks(spark, d):
    """Empty text, 0 and null fall through to the second name of a field."""
    k = F.col("p_partkey")
    raw = S.table(spark, d, "part").select(
        k.alias("id"), F.concat(F.lit(" N_"), k.cast("string")).alias("name"), F.when(k % 4 == 3, "").otherwise("desc").alias("description"), F.lit("raw").alias("summary"),
        F.when(k % 3 == 0, "a; b,").when(k % 3 == 1, F.lit(None)).otherwise("x").alias("keywords"), (k % 5).alias("repository_stars_count"), F.lit(7).alias("stars"), F.when(k % 2 == 1, "u").otherwise("").alias("pypi_url"), F.when(k % 6 != 0, "Other").alias("platform"),
    )
    p = extract.to_packages(raw)
    return p.select(F.substring("name", 3, 20).cast("bigint").alias("id"), "summary", F.array_join("keywords", "|").alias("keywords"), "stars", F.col("pypi_url").alias("url"), "platform")


@registered("@SELECT qid, place, name, summary, round(final, 6) AS score, stars, 'https://pypi.org/project/' || name || '/' AS pypi_url FROM top JOIN every USING (key) WHERE place <= 8")
def slim_hits(spark, d):
    return search.slim(_hits(spark, d)).withColumns({"place": F.col("place").cast("bigint"), "score": F.round("score", 6)})


@registered("@SELECT qid, place, printf('%2d. ', place) || name || printf('  score=%.3f', final) || '  \u2605' || stars || chr(10) || '    ' || CASE WHEN length(s) > 100 THEN substr(s, 1, 97) || '...' ELSE s END || chr(10) || '    https://pypi.org/project/' || name || '/' AS text FROM (SELECT *, CASE WHEN key % 2 = 0 THEN repeat(summary || ' ', 4) || '.' ELSE summary END AS s FROM top JOIN every USING (key)) WHERE place <= 8")
def result_text(spark, d):
    """Hits as lines for a terminal; every other summary is long and cut."""
    from ..cli import result_text as lines

    long = F.when(F.split("name", "-")[1].cast("long") % 2 == 0, F.concat(F.repeat(F.concat("summary", F.lit(" ")), 4), F.lit("."))).otherwise(F.col("summary"))
    return lines(search.slim(_hits(spark, d)).withColumn("summary", long)).withColumn("place", F.col("place").cast("bigint"))


_LATE = "(SELECT *, CASE WHEN key % 3 = 0 THEN TIMESTAMP '2001-06-01' ELSE ts END AS seen, '>=3.' || key % 4 AS python FROM corpus)"


@registered(f"@SELECT qid, id, rank, round(s, 6) AS score FROM (SELECT qid, key AS id, score AS s, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM scored JOIN {_LATE} USING (key) WHERE python = '>=3.2' AND stars >= 0) WHERE rank <= 10")
def python_filter(spark, d):
    """An exact match of requires_python, and min_stars 0, which is a filter too."""
    corpus = S.stored_corpus(spark, d).withColumn("requires_python", F.concat(F.lit(">=3."), (F.col("id") % 4).cast("string")))
    return search.nearest(S.query_vectors(spark, d), corpus, 10, search.payload_filter(min_stars=0, requires_python=">=3.2")).select("qid", "id", F.col("rank").cast("bigint").alias("rank"), six(F.col("score"), "score"))


@registered(f"@SELECT key AS id, round(0.10 * exp(-greatest(epoch_us(TIMESTAMP '{S.AS_OF}') - epoch_us(seen), 0) / 86400000000.0 / 180.0), 6) AS recent FROM {_LATE}")
def commit_recency(spark, d):
    """The last commit counts where there is one, else the latest release."""
    corpus = S.stored_corpus(spark, d).withColumn("last_commit", F.when(F.col("id") % 3 == 0, F.to_timestamp(F.lit("2001-06-01"))))
    return search.blended(corpus.select("id", "last_commit", "latest_release", F.lit(0.0).alias("relevance")), as_of()).select("id", six(F.col("final"), "recent"))


@registered("@SELECT qid, key AS id, place, round(final, 6) AS final FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, rank) AS place FROM blended WHERE rank <= 20) WHERE place <= 10")
def rerank_fallback(spark, d):
    """Reranking asked for without a scorer: candidates are cut to 20 all the same and keep their scores."""
    return _search(spark, d, use_rerank=True).select("qid", "id", F.col("place").cast("bigint").alias("place"), six(F.col("final"), "final"))


@registered("""@SELECT qid, key AS id, place, round(relevance, 6) AS relevance FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY 0.75 * relevance + 0.15 * CASE WHEN sr <> 0 THEN pop ELSE pop0 END + 0.10 * rec DESC, rank) AS place FROM (
    SELECT *, CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 1.0 END AS relevance FROM (
      SELECT *, min(s) OVER (PARTITION BY qid) AS lo, max(s) OVER (PARTITION BY qid) AS hi FROM (
        SELECT knn.qid, knn.key, knn.rank, CAST((knn.key * 7919 + knn.qid) % 101 AS DOUBLE) AS s FROM knn WHERE rank <= 50))) JOIN algebra USING (key)) WHERE place <= 8""")
def grounded_search(spark, d):
    """The retrieval before generation: 50 retrieved, all 50 reranked, 8 kept."""
    scorer = lambda c: c.withColumn("rerank_score", ((F.col("id") * 7919 + F.col("qid")) % 101).cast("double"))
    found = search.retrieve_for_answer(S.query_vectors(spark, d), S.stored_corpus(spark, d), as_of(), scorer=scorer)
    return found.select("qid", "id", F.col("place").cast("bigint").alias("place"), six(F.col("relevance"), "relevance"))


@registered("""SELECT c_custkey AS qid, CAST(CASE WHEN c_custkey % 9 IN (0, 1, 2) THEN c_custkey % 9 + 1 ELSE 0 END AS BIGINT) AS n,
  CASE WHEN c_custkey % 9 > 7 THEN 'not JSON' WHEN c_custkey % 9 > 2 THEN 'not a list of one to three recommendations' END AS parse_error FROM customer""")
def answer_constraints(spark, d):
    """One to three good items; four, none, a reason too long or empty, a quote too long, a missing name, broken JSON."""
    k = F.col("c_custkey") % 9
    item = lambda i: F.struct(F.when((k != 7) | (i > 1), F.lit("p")).alias("package"), F.repeat(F.lit("r"), F.when(k == 5, 801).when((k == 6) & (i == 1), 0).otherwise(800)).alias("reason"), F.repeat(F.lit("q"), F.when((k == 4) & (i == 1), 401).otherwise(400)).alias("cited_snippet"))
    many = F.when(k < 3, k + 1).when(k == 3, 4).otherwise(2).cast("int")
    body = F.to_json(F.struct(F.transform(F.sequence(F.lit(1), many), item).alias("recommendations")))
    # Keys are dealt before texts are made of them: the table has few files, and its texts are some hundred times its size.
    dealt = S.table(spark, d, "customer").select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    raw = dealt.select(F.col("c_custkey").alias("qid"), F.when(k == 8, F.substring(body, 1, 50)).otherwise(body).alias("raw"))
    return rag.parse_answers(raw).select("qid", F.size("recommendations").cast("bigint").alias("n"), "parse_error")


@registered(f"""WITH q AS (SELECT DISTINCT conv_id AS qid FROM conversations), e AS (
  SELECT qid, 0 AS seq, 'ranked_list' AS event, CAST(qid AS VARCHAR) AS data FROM q
  UNION ALL SELECT conv_id, turn + 1, 'llm_delta', '{{"text":"' || turn || '"}}' FROM conversations WHERE conv_id % 3 <> 0
  UNION ALL SELECT qid, 2000000000, 'llm_error', '{{"message":"{rag.NOTHING_FOUND}"}}' FROM q WHERE qid % 3 = 0
  UNION ALL SELECT qid, 2000000000, 'llm_error', '{{"message":"late"}}' FROM q WHERE qid % 3 = 1
  UNION ALL SELECT qid, 2000000000, 'llm_done', 'ok' FROM q WHERE qid % 3 = 2) SELECT qid, CAST(seq AS INTEGER) AS seq, event, data FROM e""")
def answer_events(spark, d):
    """What a client sees: a third of the queries found nothing, a third break off, a third are answered."""
    talk = S.table(spark, d, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("seq"), F.col("turn").cast("string").alias("text"))
    q = talk.select("qid").distinct()
    ranked = q.select("qid", F.col("qid").cast("string").alias("data"), F.when(F.col("qid") % 3 == 0, 0).otherwise(5).alias("n"))
    return rag.events(ranked, talk, q.select("qid", F.lit("ok").alias("data")), q.where("qid % 3 = 1").select("qid", F.lit("late").alias("message")))


@registered("@SELECT name FROM doc WHERE sourcerank % 2 = 0")
def changed_documents(spark, d):
    """Only packages whose document differs from the stored one."""
    old = S.packages(spark, d)
    new = documents.transform(old.withColumn("summary", F.when(F.col("sourcerank") % 2 == 0, F.concat("summary", F.lit(" now"))).otherwise(F.col("summary"))))
    return documents.changed(new, old).select("name")
