"""The reference operators as queries over the standard tables, with equivalent SQL for each where SQL can say it.

conversations stand for documents with pages (conv_id, turn + 1), embeddings for chunk vectors (label: document or relevance class),
benchmark for questions, events for latency samples. Query vectors are those whose id is divisible by 100.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import text as T
from folio.operators import candidates, chunking, evaluation, evidence, grounding, planner, qa, question_checks, questions, ranking, reports, search, store, vectors
from folio.plans.registry import ORACLES, QUERIES, pages, query, read  # noqa: F401  the catalogue is read from here

ASKED = "vec_id % 100 = 0"
DOT = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
TOPK = f"""q AS (SELECT vec_id AS query_id, label AS ql, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, ql, vec_id, label, round(greatest(-1.0, least(1.0, {DOT.format(a='qe', b='embedding')})), 6) AS score FROM q, embeddings WHERE vec_id <> query_id)"""
RANKED = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"


@query(f"WITH {TOPK} SELECT query_id, vec_id, score, rank FROM (SELECT *, CAST({RANKED} AS INTEGER) AS rank FROM s) WHERE rank <= 5")
def vector_topk_batch(spark, d):
    e = read(spark, d, "embeddings")
    return vectors.top_k_batch(e, e.where(ASKED), 5)


@query(f"WITH {TOPK} SELECT query_id, vec_id, score, rank FROM (SELECT *, CAST({RANKED} AS INTEGER) AS rank FROM s WHERE label = ql) WHERE rank <= 5")
def vector_topk_filtered_pre(spark, d):
    e = read(spark, d, "embeddings")
    return vectors.top_k_batch(e, e.where(ASKED), 5, same_label=True)


@query(f"WITH {TOPK}, w AS (SELECT *, {RANKED} AS r FROM s), k AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) AS INTEGER) AS rank FROM w WHERE r <= 30 AND label = ql) SELECT * FROM k WHERE rank <= 3")
def vector_topk_filtered_post(spark, d):
    e = read(spark, d, "embeddings")
    return vectors.top_k_post_filter(e, e.where(ASKED), 3)


@query(f"SELECT e.vec_id, round(greatest(-1.0, least(1.0, {DOT.format(a='e.embedding', b='q.embedding')})), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_single(spark, d):
    e = read(spark, d, "embeddings")
    return vectors.top_k(e, e.where("vec_id = 0").first().embedding, 10)


@query(f"SELECT vec_id, round(sqrt({DOT.format(a='embedding', b='embedding')}), 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@query("SELECT count(*) AS n, count(*) FILTER (embedding IS NULL) AS missing, count(*) FILTER (len(embedding) <> 64) AS wrong_dimension, count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS not_finite FROM embeddings")
def vector_dimension_audit(spark, d):
    return vectors.dimension_audit(read(spark, d, "embeddings"), 64)


@query("SELECT count(*) AS n_vectors, string_agg(DISTINCT CAST(label AS VARCHAR), ',' ORDER BY CAST(label AS VARCHAR)) AS groups, CAST(max(len(embedding)) AS INTEGER) AS dimension FROM embeddings")
def index_metadata(spark, d):
    return vectors.index_metadata(read(spark, d, "embeddings"), "label")


@query("SELECT count(*) AS n, count(*) = count(DISTINCT vec_id) AND coalesce(min(vec_id), 0) = 0 AND coalesce(max(vec_id), -1) = count(*) - 1 AS contiguous FROM embeddings")
def index_slots(spark, d):
    return store.slots_contiguous(read(spark, d, "embeddings"), "vec_id")


@query("SELECT doc_id, vec_id IS NOT NULL AS embedded, CAST(coalesce(len(embedding), 0) AS INTEGER) AS dimension FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def embedding_upsert(spark, d):
    chunks = read(spark, d, "documents").select("doc_id", F.lit(None).cast("array<float>").alias("embedding"))
    up = store.upsert_vectors(chunks, read(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", 64)
    return up.select("doc_id", F.col("embedding").isNotNull().alias("embedded"), F.greatest(F.coalesce(F.size("embedding"), F.lit(0)), F.lit(0)).alias("dimension"))


@query("SELECT count(*) AS n, count(*) FILTER (label <> 3 AND embedding IS NOT NULL) AS left_over FROM embeddings")
def embedding_delete(spark, d):
    e = store.clear_vectors(read(spark, d, "embeddings"), "embedding", F.col("label") == 3)
    return e.agg(F.count("*").alias("n"), F.count("embedding").alias("left_over"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) ORDER BY n_chars, doc_id LIMIT 30")
def unembedded_chunks(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return store.unembedded(read(spark, d, "documents").join(v, "doc_id", "left"), "embedding", "n_chars", "doc_id", 30).select("doc_id", "n_chars")


def _registry(spark, d, how: str) -> search.Registry:
    e = read(spark, d, "embeddings").withColumn("document_id", F.col("label").cast("string"))
    r = search.Registry()
    r.add("all", search.Index(e, how))
    return r


def _asked(spark, d) -> list[float]:
    return list(read(spark, d, "embeddings").where("vec_id = 0").first().embedding)


NEAR_0 = f"s AS (SELECT e.vec_id, e.label, round(greatest(-1.0, least(1.0, {DOT.format(a='q.embedding', b='e.embedding')})), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


@query(f"""WITH {NEAR_0}, p AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS original_rank, (vec_id * 31 % 97) / 97.0 AS new_score FROM s WHERE label = 3 QUALIFY original_rank <= 20)
SELECT vec_id, score, CAST(original_rank AS INTEGER) AS original_rank, CAST(new_score AS DOUBLE) AS new_score, CAST(row_number() OVER (ORDER BY new_score DESC, score DESC, original_rank) AS INTEGER) AS rank FROM p QUALIFY rank <= 5""")
def search_document_reranked(spark, d):
    return search.search(_registry(spark, d, "pre"), _asked(spark, d), 5, document_id=" 3 ", scorer=(F.col("vec_id") * 31 % 97) / 97.0)


@query(f"""WITH {NEAR_0}, w AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM s), k AS (SELECT * FROM w WHERE r <= 50 AND label = 3)
SELECT vec_id, score, CAST(row_number() OVER (ORDER BY r) AS INTEGER) AS original_rank, CAST(NULL AS DOUBLE) AS new_score, CAST(row_number() OVER (ORDER BY r) AS INTEGER) AS rank FROM k QUALIFY rank <= 5""")
def search_document_post_filter(spark, d):
    return search.search(_registry(spark, d, "post"), _asked(spark, d), 5, document_id="3")


@query("SELECT vec_id AS slot, vec_id, len(embedding) AS dimension FROM embeddings")
def index_save_load(spark, d):
    import uuid

    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    path = f"{store.scratch(spark)}/index-{uuid.uuid4().hex}"
    first = v.where("vec_id % 2 = 0").limit(0).withColumn("slot", F.col("vec_id"))
    store.save_index(store.add_to_index(first, v), path)
    return store.load_index(spark, path).select("slot", "vec_id", F.size("embedding").cast("bigint").alias("dimension"))


@query("SELECT (SELECT count(*) FROM documents) AS documents, EXISTS (SELECT 1 FROM embeddings WHERE label = 3) AS has_3, EXISTS (SELECT 1 FROM embeddings WHERE label = 77) AS has_77, (SELECT count(*) FROM embeddings) AS vectors, (SELECT len(embedding) FROM embeddings WHERE vec_id = 4) AS dimension_4")
def repository_probes(spark, d):
    e = read(spark, d, "embeddings")
    index = _registry(spark, d, "pre").get()
    row = (store.count(read(spark, d, "documents")), index.has_document("3"), index.has_document("77"), index.total(), len(store.embedding_of(e, "vec_id", 4)))
    return spark.createDataFrame([row], "documents bigint, has_3 boolean, has_77 boolean, vectors bigint, dimension_4 bigint")


@query("SELECT conv_id AS document_id, CAST(turn + 1 AS INTEGER) AS page_number, turn AS chunk_index, text FROM conversations WHERE conv_id = 7 AND turn = 2 UNION ALL SELECT conv_id, CAST(turn + 1 AS INTEGER), turn, text FROM conversations WHERE conv_id = 8")
def chunk_lookups(spark, d):
    c = pages(spark, d).withColumn("chunk_index", (F.col("page_number") - 1).cast("bigint")).select("document_id", "page_number", "chunk_index", "text")
    return store.chunks_for_questions(c, c, 7, 3).unionByName(store.chunks_for_questions(c.where("document_id < 0"), c, 8))


def _pools(spark, d) -> DataFrame:
    e = read(spark, d, "embeddings")
    found = vectors.top_k_batch(e, e.where(ASKED), 20)
    return found.select((F.col("query_id") / 300).cast("bigint").alias("plan_id"), (F.col("query_id") / 100 % 3).cast("bigint").alias("position"), F.col("query_id").alias("sub_query"), F.col("vec_id").alias("item"), "score", "rank")


POOLS = f"""{TOPK}, pools AS (SELECT query_id // 300 AS plan_id, query_id // 100 % 3 AS position, query_id AS sub_query, vec_id AS item, score, rank FROM (SELECT *, CAST({RANKED} AS INTEGER) AS rank FROM s) WHERE rank <= 20)"""


@query(f"""WITH {POOLS}, g AS (SELECT plan_id, item, max(score) AS score, first(rank ORDER BY score DESC, position) AS original_rank, min(position) AS first_seen, string_agg(CAST(sub_query AS VARCHAR), ',' ORDER BY position) AS matched FROM pools GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY score DESC, first_seen, item) AS INTEGER) AS rank FROM g""")
def multi_query_merge(spark, d):
    return ranking.merge(_pools(spark, d))


RERANK = f"""WITH {TOPK}, pool AS (SELECT query_id, vec_id AS item, score, {RANKED} AS original_rank FROM s), cut AS (SELECT *, (item * 7919 + query_id) % 101 / 100.0 AS new_score FROM pool WHERE original_rank <= 20),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY new_score DESC, score DESC, original_rank) AS rank FROM cut)"""


def _reranked(spark, d, n: int) -> DataFrame:
    e = read(spark, d, "embeddings")
    pool = vectors.top_k_batch(e, e.where(ASKED), 20).withColumnRenamed("vec_id", "item")
    return ranking.rerank(pool, (F.col("item") * 7919 + F.col("query_id")) % 101 / 100.0, n)


@query(RERANK + " SELECT query_id, item, score, CAST(original_rank AS INTEGER) AS original_rank, CAST(new_score AS DOUBLE) AS new_score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def rerank_order(spark, d):
    return _reranked(spark, d, 5)


@query(RERANK + " SELECT query_id, item, CAST(original_rank - rank AS INTEGER) AS moved, CASE WHEN original_rank > rank THEN 'up' WHEN original_rank < rank THEN 'down' ELSE 'same' END AS direction FROM r WHERE rank <= 20")
def rank_movement(spark, d):
    return _reranked(spark, d, 20).select("query_id", "item", ranking.movement().alias("m")).select("query_id", "item", "m.moved", "m.direction")


@query(RERANK + " SELECT query_id, count(*) AS kept, max(CAST(original_rank AS INTEGER)) AS deepest FROM r WHERE rank <= 5 GROUP BY query_id")
def candidate_cascade(spark, d):
    return _reranked(spark, d, 5).groupBy("query_id").agg(F.count("*").alias("kept"), F.max("original_rank").alias("deepest"))


@query("SELECT vec_id, round(CASE WHEN vec_id % 2 = 0 THEN greatest(5.0, least(100.0, 100 / (1 + exp(-(vec_id % 17 - 8.0))))) ELSE greatest(0.0, least(100.0, 100 * (vec_id % 13 - 2) / 10.0)) END, 2) AS shown FROM embeddings")
def display_scores(spark, d):
    v = F.col("vec_id")
    return read(spark, d, "embeddings").select("vec_id", ranking.display_score((v % 13 - 2) / 10.0, F.when(v % 2 == 0, v % 17 - 8.0)).alias("shown"))


def _hits(spark, d, k: int = 10, invert: bool = False) -> tuple[DataFrame, DataFrame]:
    e = read(spark, d, "embeddings")
    asked = e.where(ASKED)
    found = vectors.top_k_batch(e, asked, k)
    lab = e.select(F.col("vec_id"), F.col("label").alias("hit"))
    q = asked.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want"))
    rank = (k + 1 - F.col("rank")) if invert else F.col("rank")
    hits = found.join(lab, "vec_id").join(q, "query_id").select("query_id", F.col("vec_id").alias("item"), rank.alias("rank"), (F.col("hit") == F.col("want")).alias("relevant"))
    n = q.join(e.groupBy(F.col("label").alias("want")).agg((F.count("*") - 1).alias("n_relevant")), "want").select("query_id", "n_relevant")
    return hits, n


HITS = f"""{TOPK}, h AS (SELECT query_id, vec_id, rank, label = ql AS rel FROM (SELECT *, CAST({RANKED} AS INTEGER) AS rank FROM s) WHERE rank <= 10),
nrel AS (SELECT query_id, (SELECT count(*) - 1 FROM embeddings e WHERE e.label = q.ql) AS n_relevant FROM q)"""
METRICS = "SELECT n.query_id, n.n_relevant, " + ", ".join(f"round(coalesce(CASE WHEN n_relevant > 0 THEN count(*) FILTER (rel AND rank <= {k}) / n_relevant ELSE 0.0 END, 0.0), 4) AS recall_{k}" for k in (1, 3, 5, 10)) + ", " + ", ".join(f"round(count(*) FILTER (rel AND rank <= {k}) / {k}, 4) AS precision_{k}" for k in (1, 3, 5, 10)) + ", round(coalesce(1 / min(rank) FILTER (rel), 0.0), 4) AS rr, min(rank) FILTER (rel) AS first_rank FROM nrel n LEFT JOIN {h} h ON h.query_id = n.query_id GROUP BY n.query_id, n.n_relevant"


@query(f"WITH {HITS}, m AS ({METRICS.replace('{h}', 'h')}) SELECT * REPLACE (coalesce(first_rank, 0) AS first_rank) FROM m")
def recall_precision_at_k(spark, d):
    return evaluation.retrieval_metrics(*_hits(spark, d)).withColumn("first_rank", F.coalesce("first_rank", F.lit(0)))


@query(f"WITH {HITS}, m AS ({METRICS.replace('{h}', 'h')}) SELECT count(*) AS queries, " + ", ".join(f"round(avg({m}_{k}), 4) AS {m}_{k}" for m in ("recall", "precision") for k in (1, 3, 5, 10)) + ", round(avg(rr), 4) AS mrr FROM m WHERE n_relevant > 0")
def mrr(spark, d):
    return evaluation.aggregate_retrieval(evaluation.retrieval_metrics(*_hits(spark, d)))


@query(f"""WITH {HITS}, h2 AS (SELECT query_id, vec_id, 11 - rank AS rank, rel FROM h), a AS ({METRICS.replace('{h}', 'h')}), b AS ({METRICS.replace('{h}', 'h2')}),
j AS (SELECT a.rr AS rr1, b.rr AS rr2, a.first_rank AS r1, b.first_rank AS r2 FROM a JOIN b USING (query_id) WHERE a.n_relevant > 0),
g AS (SELECT round(avg(rr1), 4) AS mrr_before, round(avg(rr2), 4) AS mrr_after, count(*) FILTER ((r1 IS NULL AND r2 IS NOT NULL) OR r2 < r1) AS improved, count(*) FILTER ((r1 IS NOT NULL AND r2 IS NULL) OR r2 > r1) AS degraded, count(*) FILTER (r1 IS NOT DISTINCT FROM r2) AS unchanged FROM j),
e AS (SELECT *, round(mrr_after - mrr_before, 4) AS delta FROM g) SELECT *, CASE WHEN delta > 0 OR improved > degraded THEN 'improved' WHEN delta < 0 OR degraded > improved THEN 'degraded' ELSE 'neutral' END AS effect FROM e""")
def stage_comparison(spark, d):
    return evaluation.compare_stages(evaluation.retrieval_metrics(*_hits(spark, d)), evaluation.retrieval_metrics(*_hits(spark, d, invert=True)))


@query("SELECT source, count(*) AS n, round((count(*) - count(DISTINCT text)) / count(*), 4) AS duplicate_rate FROM documents GROUP BY source")
def duplicate_rate(spark, d):
    return evaluation.duplicate_rate(read(spark, d, "documents"), "source", "text")


@query(f"""WITH {HITS}, p AS (SELECT query_id, rank, vec_id % 7 AS page FROM h), r AS (SELECT DISTINCT q.query_id, e.vec_id % 7 AS page FROM q JOIN embeddings e ON e.label = q.ql WHERE e.vec_id % 3 = 0),
n AS (SELECT query_id, count(*) AS n FROM r GROUP BY query_id), j AS (SELECT p.*, r.page IS NOT NULL AS hit FROM p LEFT JOIN r USING (query_id, page)),
g AS (SELECT query_id, """ + ", ".join(f"count(*) FILTER (hit AND rank <= {k}) AS h{k}, count(DISTINCT page) FILTER (hit AND rank <= {k}) AS d{k}" for k in (1, 3, 5, 10)) + ", min(rank) FILTER (hit) AS f, round((count(*) - count(DISTINCT page)) / count(*), 4) AS dup FROM j GROUP BY query_id) SELECT query_id, " + ", ".join(f"round(coalesce(d{k}, 0) / n, 4) AS page_recall_{k}, round(coalesce(h{k}, 0) / {k}, 4) AS page_precision_{k}" for k in (1, 3, 5, 10)) + ", round(coalesce(1 / f, 0.0), 4) AS page_rr, coalesce(dup, 0.0) AS page_duplicate_rate FROM n LEFT JOIN g USING (query_id)")
def page_recall_precision(spark, d):
    e = read(spark, d, "embeddings")
    asked = e.where(ASKED)
    hits = vectors.top_k_batch(e, asked, 10).select("query_id", "rank", (F.col("vec_id") % 7).alias("page"))
    relevant = asked.select(F.col("vec_id").alias("query_id"), "label").join(e.where("vec_id % 3 = 0").select("label", (F.col("vec_id") % 7).alias("page")), "label").select("query_id", "page")
    return evaluation.page_metrics(hits, relevant)


TOKENS = "regexp_extract_all(lower({c}), '([a-z0-9]+)', 1)"
BARE = "list_filter(string_split_regex(regexp_replace(lower({c}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the'))"
TURNS = "t AS (SELECT conv_id * 100 + turn AS pair_id, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), p AS (SELECT pair_id, " + BARE.format(c="a") + " AS a, " + BARE.format(c="b") + " AS b FROM t WHERE b IS NOT NULL)"


@query(f"""WITH {TURNS}, x AS (SELECT pair_id, t, count(*) AS n FROM (SELECT pair_id, unnest(a) AS t FROM p) GROUP BY ALL), y AS (SELECT pair_id, t, count(*) AS n FROM (SELECT pair_id, unnest(b) AS t FROM p) GROUP BY ALL),
c AS (SELECT pair_id, sum(least(x.n, y.n)) AS common FROM x JOIN y USING (pair_id, t) GROUP BY pair_id)
SELECT pair_id, CAST(coalesce(common, 0) AS BIGINT) AS common, round(CASE WHEN coalesce(common, 0) = 0 THEN 0.0 ELSE 2.0 * CAST(common AS DOUBLE) / (len(a) + len(b)) END, 4) AS f1 FROM p LEFT JOIN c USING (pair_id)""")
def token_f1(spark, d):
    c = read(spark, d, "conversations").withColumn("pair_id", F.col("conv_id") * 100 + F.col("turn"))
    c = c.withColumn("b", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return evaluation.token_f1(c, T.answer_tokens(F.col("text")), T.answer_tokens(F.col("b")))


#: Answers as they are, and cut off by each phrase in turn.
@query("""WITH w(k, phrase) AS (VALUES (0, ''), (1, 'It is unanswerable.'), (2, 'That is out of scope'), (3, 'One cannot determine it'), (4, 'I cannot answer.'), (5, 'There is insufficient evidence'), (6, 'This is NOT PROVIDED'), (7, 'not mentioned there'), (8, 'no evidence'), (9, 'cannot say'), (10, 'no relevant page, unable to tell')),
t AS (SELECT conv_id * 1000 + turn * 20 + k AS id, CASE WHEN k = 0 THEN text ELSE substr(text, 1, 20) || ' ' || phrase END AS a FROM conversations, w WHERE role = 'assistant')
SELECT id, coalesce(a, '') = '' OR regexp_matches(lower(a), 'cannot answer|insufficient evidence|not provided|not mentioned|no evidence|unanswerable|cannot determine|out of scope') AS refused FROM t""")
def refusal_detection(spark, d):
    said = ("", "It is unanswerable.", "That is out of scope", "One cannot determine it", "I cannot answer.", "There is insufficient evidence", "This is NOT PROVIDED", "not mentioned there", "no evidence", "cannot say", "no relevant page, unable to tell")
    c = read(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text", F.posexplode(F.array(*[F.lit(x) for x in said])).alias("k", "phrase"))
    a = F.when(F.col("k") == 0, F.col("text")).otherwise(F.concat(F.substring("text", 1, 20), F.lit(" "), F.col("phrase")))
    return c.select((F.col("conv_id") * 1000 + F.col("turn") * 20 + F.col("k")).alias("id"), evaluation.declines(a).alias("refused"))


@query("SELECT lang, source, count(*) AS documents, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, round(avg(n_chars), 4) AS mean_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (lang, source))")
def category_report(spark, d):
    j = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    return j.groupingSets([[], ["lang"], ["lang", "source"]], "lang", "source").agg(F.count("*").alias("documents"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("""WITH c AS (SELECT source, avg(CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END) AS refusal, avg(CAST(quality AS DOUBLE)) AS mrr, avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END) AS success, max(toxic) AS fr, bool_or(quality = 0) AS neg FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, CASE WHEN neg THEN CASE WHEN refusal = 1.0 THEN 'PASS' WHEN refusal >= 0.75 THEN 'WARNING' ELSE 'FAIL' END WHEN mrr >= 0.8 AND success >= 0.75 AND fr = 0 THEN 'PASS' WHEN mrr >= 0.5 OR success >= 0.5 THEN 'WARNING' ELSE 'FAIL' END AS verdict FROM c""")
def query_type_verdicts(spark, d):
    j = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    g = j.groupBy("source").agg(F.avg((F.col("quality") == 0).cast("double")).alias("refusal"), F.avg("quality").alias("mrr"), F.avg((F.col("toxic") == 0).cast("double")).alias("success"), F.max("toxic").alias("fr"), F.bool_or(F.col("quality") == 0).alias("neg"))
    return g.select("source", evaluation.verdict(F.col("neg"), F.col("refusal"), F.col("mrr"), F.col("success"), F.col("fr")).alias("verdict"))


@query("""WITH c AS (SELECT lang, count(*) FILTER (quality = 0 AND toxic = 1) AS wrong, avg(CAST(quality AS DOUBLE)) AS prec, avg(CAST(toxic AS DOUBLE)) AS fr FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, CASE WHEN wrong > 0 THEN 'FAIL' WHEN prec < 1 OR fr > 0.1 THEN 'WARNING' ELSE 'PASS' END AS status FROM c""")
def safety_report(spark, d):
    j = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    g = j.groupBy("lang").agg(F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("wrong"), F.avg("quality").alias("prec"), F.avg("toxic").alias("fr"))
    return g.select("lang", evaluation.safety(F.col("wrong"), F.col("prec"), F.col("fr")).alias("status"))


@query("""WITH c AS (SELECT conv_id AS chunk_id, turn AS page, CASE role WHEN 'user' THEN 'accepted' WHEN 'system' THEN 'duplicate' ELSE 'low_quality' END AS outcome, turn < 6 AS complete,
  lower(text) AS t, lower(substr(text, 3, 12)) AS a FROM conversations),
k AS (SELECT chunk_id, min(page) AS page, count(*) AS raw, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'duplicate') AS dup, count(*) FILTER (outcome = 'low_quality') AS qual,
  coalesce(bool_and(complete) FILTER (outcome = 'accepted'), true) AS complete, coalesce(bool_and(a = '' OR t = '' OR contains(t, a)) FILTER (outcome = 'accepted'), true) AS grounded FROM c GROUP BY chunk_id),
s AS (SELECT count(*) AS chunks, count(DISTINCT page) AS pages, CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(dup) AS BIGINT) AS dup, CAST(sum(qual) AS BIGINT) AS qual,
  sum(accepted) FILTER (complete) AS p, sum(accepted) FILTER (grounded) AS g FROM k),
r AS (SELECT chunks, pages, raw, accepted, raw - accepted AS rejected, round(accepted / raw, 4) AS accepted_rate, round((raw - accepted) / raw, 4) AS rejected_rate, round(dup / raw, 4) AS duplicate_rate, 0.0::DOUBLE AS mismatch_rate,
  0.0::DOUBLE AS unanswerable_rate, round(qual / raw, 4) AS quality_rate, round(coalesce(p, 0) / accepted, 4) AS provenance_rate, round(coalesce(g, 0) / accepted, 4) AS grounding_rate FROM s)
SELECT *, CASE WHEN accepted = 0 THEN 'FAIL' WHEN provenance_rate >= 0.99 AND grounding_rate >= 0.95 THEN 'PASS' ELSE 'WARNING' END AS status FROM r""")
def generation_report(spark, d):
    c = read(spark, d, "conversations")
    outcome = F.when(F.col("role") == "user", "accepted").when(F.col("role") == "system", "duplicate").otherwise("low_quality")
    asked = c.select(F.col("conv_id").alias("chunk_id"), F.col("turn").alias("page_number"), outcome.alias("outcome"), (F.col("turn") < 6).alias("complete"), evaluation.grounded(F.substring("text", 3, 12), F.col("text")).alias("grounded"))
    return evaluation.generation_report(asked)


@query("""WITH g AS (SELECT conv_id, list(DISTINCT turn) AS required, list(DISTINCT turn) FILTER (role = 'user') AS retrieved FROM conversations GROUP BY conv_id)
SELECT conv_id, round(len(list_intersect(required, coalesce(retrieved, []))) / len(required), 4) AS covered, len(list_filter(required, lambda x: NOT list_contains(coalesce(retrieved, []), x))) = 0 AS complete FROM g""")
def multipage_coverage(spark, d):
    g = read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("turn").alias("required"), F.collect_set(F.when(F.col("role") == "user", F.col("turn"))).alias("retrieved"))
    return g.select("conv_id", evaluation.page_coverage(F.col("required"), F.col("retrieved")).alias("p")).select("conv_id", "p.covered", "p.complete")


LATENCY = "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.95), 4) AS p95, round(min(value), 4) AS least, round(max(value), 4) AS greatest FROM (SELECT CASE event_type WHEN 'view' THEN 'retrieval' ELSE event_type END AS event_type, value FROM events) WHERE value IS NOT NULL GROUP BY event_type"


def _stages(spark, d) -> DataFrame:
    """Events as latency samples; one kind stands for a stage with its own limit."""
    return read(spark, d, "events").withColumn("event_type", F.when(F.col("event_type") == "view", "retrieval").otherwise(F.col("event_type")))


@query(f"SELECT *, mean >= CASE event_type WHEN 'retrieval' THEN 50 ELSE 250 END AS bottleneck FROM ({LATENCY})")
def latency_percentiles(spark, d):
    return evaluation.latency(_stages(spark, d), "event_type", "value")


@query(f"WITH s AS ({LATENCY}) SELECT (SELECT event_type FROM s ORDER BY mean DESC, event_type LIMIT 1) AS slowest, round(sum(mean), 4) AS mean, round(sum(median), 4) AS median, round(sum(p95), 4) AS p95 FROM s")
def latency_report(spark, d):
    return evaluation.latency_report(evaluation.latency(_stages(spark, d), "event_type", "value"), "event_type")


BUDGET = """WITH e AS (SELECT conv_id AS query_id, turn AS rank, turn + 1 AS page, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE trim(coalesce(text, '')) <> ''),
b AS (SELECT *, '[Page ' || page || '] ' || text AS block FROM e), c AS (SELECT *, greatest(1, CAST(floor(length(block) / 3.5) AS INTEGER)) AS tok FROM b),
k AS (SELECT *, CASE WHEN n = 1 AND tok > 200 THEN 200 ELSE tok + CAST(n > 1 AS INTEGER) END AS cost, CASE WHEN n = 1 AND tok > 200 THEN substr(block, 1, 700) || '...' ELSE block END AS shown FROM c),
u AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM k)"""


@query(BUDGET + " SELECT query_id, string_agg(shown, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS blocks, CAST(max(used) AS BIGINT) AS used FROM u WHERE used <= 200 GROUP BY query_id")
def evidence_budget(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), (F.col("turn") + 1).alias("page"), "text")
    return evidence.prompts(evidence.pack(c, 230, 30))


CLAIMS = r"""cl AS (SELECT conv_id * 100 + turn AS answer_id, pos, claim FROM (SELECT conv_id, turn, generate_subscripts(parts, 1) AS pos, unnest(parts) AS claim FROM (SELECT conv_id, turn, list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS parts FROM conversations WHERE role = 'assistant')) WHERE length(claim) >= 3),
claims AS (SELECT answer_id, CAST(row_number() OVER (PARTITION BY answer_id ORDER BY pos) - 1 AS INTEGER) AS claim_index, claim FROM cl)"""


def _claims(spark, d) -> DataFrame:
    a = read(spark, d, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), "text")
    return grounding.claims(a)


@query(f"WITH {CLAIMS} SELECT * FROM claims")
def claim_decompose(spark, d):
    return _claims(spark, d)


FINITE = "'(^|[^\\p{L}\\p{N}_])(is|are|was|were|has|have|had|do|does|did|can|could|will|would|should|may|might|must|calculates|computes|optimizes|encodes|relies|measures|evaluates|counteracts|mitigates|concatenates|discovers|propagates|exploits|operates|classifies)($|[^\\p{L}\\p{N}_])'"
NUMBER = "'(?i)^(a\\s+constant\\s+)?-?\\d+(\\.\\d+)?%?$|^\\d+(\\.\\d+)?\\s*(percent|%|parameters|layers|units)?$|^a\\s+constant\\s+\\d+$'"
FORM = f"""CASE WHEN len(list_filter(regexp_split_to_array({{c}}, '\\s+'), lambda x: x <> '')) = 0 THEN 'short_span' WHEN regexp_matches({{c}}, {NUMBER.replace("{", "{{").replace("}", "}}")}) THEN 'numerical'
  WHEN (contains({{c}}, ',') OR contains({{c}}, ' and ') OR contains({{c}}, ' or ')) AND len(list_filter(regexp_split_to_array({{c}}, '\\s+'), lambda x: x <> '')) <= 12 AND NOT regexp_matches(lower({{c}}), {FINITE.replace("{", "{{").replace("}", "}}")}) THEN 'list'
  WHEN regexp_matches(lower({{c}}), {FINITE.replace("{", "{{").replace("}", "}}")}) THEN 'declarative' WHEN len(list_filter(regexp_split_to_array({{c}}, '\\s+'), lambda x: x <> '')) <= 5 THEN 'short_span' ELSE 'noun_phrase' END"""
#: Claims as they are, and ones that look like every form.
SHAPES = ("{c}", "a constant 5", "A Constant 12", "-3.5%", "12 percent", "7 layers", "5 years", "{a} and {b}", "{a}, {b} or {a}", "It may rain on {a}", "prices could fall, or {a}", "{a} {b}", "the {a} of the {b} in the long hall beside {a}", "{a} computes {b}")
SHAPED = f"""{CLAIMS}, sw AS (SELECT *, {TOKENS.format(c='claim')} AS w FROM claims), shaped AS (SELECT (answer_id * 100 + claim_index) * 20 + i AS id, replace(replace(replace(s, '{{c}}', claim), '{{a}}', w[1]), '{{b}}', w[-1]) AS c FROM sw, (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(SHAPES))}) v(i, s) WHERE len(w) > 0)"""


def _shaped(spark, d) -> DataFrame:
    c = _claims(spark, d).withColumn("w", T.tokens(F.col("claim"))).where(F.size("w") > 0).select("answer_id", "claim_index", "claim", "w", F.posexplode(F.array(*[F.lit(x) for x in SHAPES])).alias("i", "s"))
    text = F.replace(F.replace(F.replace("s", F.lit("{c}"), F.col("claim")), F.lit("{a}"), F.element_at("w", 1)), F.lit("{b}"), F.element_at("w", -1))
    return c.select(((F.col("answer_id") * 100 + F.col("claim_index")) * 20 + F.col("i")).alias("id"), text.alias("c"))


@query(f"WITH {SHAPED} SELECT id, {FORM.format(c='c')} AS form FROM shaped")
def claim_forms(spark, d):
    return _shaped(spark, d).select("id", grounding.claim_form(F.col("c")).alias("form"))


#: Questions of every form that a fragment's statement follows.
ASKERS = ("What is the capital of France?", "Which are the {a}?", "what was {a}. ", "What follows from {a}?", "Why does {a} fall?", "Why is {a} so", "How does {a} work?", "How can one see {a}?", "Who saw {a}?", "Compare {a}", "   ")
#: The statement of a fragment c under a question, both trimmed; form: its form.
STATED = r"""CASE WHEN {asked} = '' OR {form} = 'declarative' THEN {c}
  WHEN regexp_matches(lower({q}), '^(what|which)\s+(is|are|was|were)\s+(the\s+)?.') THEN 'The ' || trim(regexp_extract({q}, '(?i)^(what|which)\s+(is|are|was|were)\s+(the\s+)?(.+)', 4)) || ' ' || CASE WHEN regexp_matches(lower({q}), '^(what|which)\s+is\s') AND (contains({f}, ',') OR contains({f}, ' and ')) THEN 'are' ELSE regexp_extract(lower({q}), '^(what|which)\s+(is|are|was|were)\s', 2) END || ' ' || {f} || '.'
  WHEN regexp_matches(lower({q}), '^what\s+.') THEN 'Regarding what ' || trim(regexp_extract({q}, '(?i)^what\s+(.+)', 1)) || ', it is ' || {f} || '.'
  WHEN regexp_matches(lower({q}), '^why\s+(does|did|do|is|are)\s+.') THEN trim(regexp_extract({q}, '(?i)^why\s+(does|did|do|is|are)\s+(.+)', 2)) || ' ' || CASE WHEN regexp_matches(lower({f}), '^(to |because|by |in order to)') THEN '' ELSE 'because ' END || {f} || '.'
  WHEN regexp_matches(lower({q}), '^how\s+(does|do|did|can)\s+.') THEN trim(regexp_extract({q}, '(?i)^how\s+(does|do|did|can)\s+(.+)', 2)) || ' ' || CASE WHEN regexp_matches(lower({f}), '^(by |through |with |using |via )') THEN '' ELSE 'by ' END || {f} || '.'
  ELSE 'Regarding ' || {q} || ', the answer is ' || {f} || '.' END"""


def stated(asked: str, c: str, form: str) -> str:
    return STATED.format(asked=asked, c=c, form=form, q=f"regexp_replace({asked}, '[?. ]+$', '')", f=f"regexp_replace({c}, '[.!?]+$', '')")


@query(f"""WITH {SHAPED}, asked AS (SELECT id * 20 + j AS id, c, {FORM.format(c='c')} AS form, trim(replace(x, '{{a}}', split_part(c, ' ', 1))) AS asked FROM shaped, (VALUES {", ".join(f"({j}, '{x}')" for j, x in enumerate(ASKERS))}) v(j, x) WHERE id % 5 = 0)
SELECT id, {stated('asked', 'c', 'form')} AS statement FROM asked""")
def claim_statements(spark, d):
    # a fragment's form doesn't depend on the question: it is told before the questions are laid beside it
    c = _shaped(spark, d).where("id % 5 = 0").select("id", "c", grounding.claim_form(F.col("c")).alias("form")).select("id", "c", "form", F.posexplode(F.array(*[F.lit(x) for x in ASKERS])).alias("j", "x"))
    asked = F.replace("x", F.lit("{a}"), F.split_part("c", F.lit(" "), F.lit(1)))
    return c.select((F.col("id") * 20 + F.col("j")).alias("id"), grounding.contextual(asked, F.col("c"), F.col("form")).alias("statement"))


def _claim_pairs(spark, d) -> DataFrame:
    ev = read(spark, d, "conversations").where("role = 'user'").select("conv_id", F.col("turn").alias("evidence_rank"), F.col("text").alias("evidence"))
    top = ev.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy("evidence_rank"))).where("r <= 5").select("conv_id", "evidence_rank", grounding.evidence_view(F.col("evidence")).alias("e"))
    c = _claims(spark, d).select("answer_id", "claim_index", (F.col("answer_id") / 100).cast("bigint").alias("conv_id"), grounding.claim_view(F.col("claim")).alias("c"))
    return c.join(top, "conv_id").select("answer_id", "conv_id", "claim_index", "evidence_rank", *[v.alias(n) for n, v in grounding.view_scores(F.col("c"), F.col("e")).items()])


_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
CONTENT = f"list_distinct(list_filter({TOKENS}, lambda x: NOT list_contains({_list(T.GROUNDING_STOPS)}, x)))"
# letters outside ASCII count as part of a word, other characters outside it as none
PLAIN = "regexp_replace(regexp_replace(lower({c}), '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', ' ', 'g'), '[^\\x00-\\x7F]', '_', 'g')"
TERMS = "list_filter(regexp_extract_all(" + PLAIN + ", '\\b([a-z0-9+*-]+)\\b', 1), lambda x: length(x) > {n} AND NOT list_contains({stops}, x))"
LIMIT = grounding.THRESHOLD
STATUS = f"""{CLAIMS}, ev AS (SELECT * FROM (SELECT conv_id, turn AS evidence_rank, lower(text) AS low, {CONTENT.format(c='text')} AS et, {TOKENS.format(c='text')} AS all_t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user') WHERE r <= 5),
ct AS (SELECT answer_id, claim_index, answer_id // 100 AS conv_id, {CONTENT.format(c='claim')} AS t, {TOKENS.format(c='claim')} AS all_t, {TERMS.format(c='claim', n=2, stops=_list(T.GROUNDING_STOPS))} AS terms FROM claims),
pr AS (SELECT answer_id, ct.conv_id, claim_index, evidence_rank, CASE WHEN len(t) = 0 THEN 0.0 ELSE round(len(list_intersect(t, et)) / len(t), 6) END AS entailment,
  list_has_any(ct.all_t, {_list(grounding.DENIALS)}) <> list_has_any(ev.all_t, {_list(grounding.DENIALS)}) AS denied, len(terms) = 0 OR len(list_filter(terms, lambda x: contains(low, x))) > 0 AS relevant FROM ct JOIN ev USING (conv_id)),
pairs AS (SELECT * EXCLUDE (denied), CASE WHEN denied THEN entailment ELSE 0.0 END AS contradiction FROM pr),
cs AS (SELECT answer_id, conv_id, claim_index, max(entailment) AS entailment, first(evidence_rank ORDER BY entailment DESC, evidence_rank) AS best_evidence, coalesce(max(contradiction) FILTER (relevant), 0.0) AS contradiction FROM pairs GROUP BY ALL),
st AS (SELECT *, CASE WHEN entailment >= {LIMIT} AND contradiction < {LIMIT} THEN 'entailed' WHEN contradiction >= {LIMIT} AND entailment < {LIMIT} THEN 'contradicted' WHEN entailment >= {LIMIT} THEN 'conflicted' ELSE 'unsupported' END AS status FROM cs)"""


@query(f"WITH {STATUS} SELECT answer_id, claim_index, entailment, best_evidence, contradiction, status FROM st")
def claim_evidence_status(spark, d):
    return grounding.claim_status(_claim_pairs(spark, d))


_n = lambda status: f"count(*) FILTER (status = '{status}')"
REPORT = f"rep AS (SELECT answer_id, count(*) AS claims, {_n('entailed')} AS supported, {_n('contradicted')} AS contradicted, {_n('conflicted')} AS conflicted, {_n('unsupported')} AS unsupported, round({_n('entailed')} / count(*), 4) AS score, CASE WHEN {_n('contradicted')} > 0 THEN 'contradicted' WHEN {_n('conflicted')} > 0 THEN 'conflicted' WHEN {_n('unsupported')} > 0 THEN 'unsupported' ELSE 'grounded' END AS overall FROM st GROUP BY answer_id)"


@query(f"WITH {STATUS}, {REPORT} SELECT * FROM rep")
def groundedness(spark, d):
    return grounding.answer_report(grounding.claim_status(_claim_pairs(spark, d)))


def _refs(spark, d) -> DataFrame:
    p = _claim_pairs(spark, d).where("entailment >= 0.2")
    return p.select("answer_id", "claim_index", F.when(F.col("evidence_rank") % 3 == 2, "contradicts").otherwise("supports").alias("kind"), F.col("evidence_rank").alias("position"), F.col("conv_id").alias("document_id"), F.col("evidence_rank").alias("chunk_id"))


REFS = "refs AS (SELECT DISTINCT answer_id, claim_index, CASE WHEN evidence_rank % 3 = 2 THEN 'contradicts' ELSE 'supports' END AS kind, evidence_rank AS position, conv_id AS document_id, evidence_rank AS chunk_id FROM pairs WHERE entailment >= 0.2)"


@query(f"""WITH {STATUS}, {REFS}, f AS (SELECT answer_id, document_id, chunk_id, min((claim_index, CASE WHEN kind = 'supports' THEN 0 ELSE 1 END, position)) AS use FROM refs GROUP BY ALL),
n AS (SELECT answer_id, document_id, chunk_id, 'cite_' || row_number() OVER (PARTITION BY answer_id ORDER BY use, document_id, chunk_id) AS citation FROM f)
SELECT answer_id, document_id, chunk_id, claim_index, kind, citation FROM refs JOIN n USING (answer_id, document_id, chunk_id)""")
def citation_numbering(spark, d):
    return grounding.citations(_refs(spark, d))


@query(f"WITH {STATUS}, {REFS} SELECT answer_id, count(DISTINCT document_id) AS documents, count(DISTINCT document_id) <= 1 AS isolated FROM refs GROUP BY answer_id")
def document_isolation(spark, d):
    return grounding.isolation(_refs(spark, d), F.floor(F.col("answer_id") / 100))


VAGUE = "What is the single best answer here?"


@query(f"""WITH {STATUS}, {REPORT}, a AS (SELECT conv_id * 100 + turn AS answer_id, conv_id, text AS answer FROM conversations WHERE role = 'assistant'), e AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id), m AS (SELECT answer_id, max(entailment) AS sim FROM pairs GROUP BY answer_id)
SELECT answer_id, CASE WHEN answer_id % 7 = 0 THEN 'needs_clarification' WHEN coalesce(n, 0) = 0 THEN 'no_evidence' WHEN coalesce(sim, 0) > 0 AND coalesce(sim, 0) < 0.2 THEN 'low_similarity' WHEN trim(coalesce(answer, '')) = '' THEN 'no_answer' WHEN coalesce(claims, 0) = 0 THEN 'no_claims' WHEN answer_id % 11 = 0 THEN 'isolation_error' WHEN overall IN ('contradicted', 'conflicted', 'unsupported') THEN 'refused' ELSE 'answered' END AS outcome
FROM a LEFT JOIN e USING (conv_id) LEFT JOIN m USING (answer_id) LEFT JOIN rep USING (answer_id)""")
def grounded_pipeline(spark, d):
    c = read(spark, d, "conversations")
    a = c.where("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), "conv_id", F.col("text").alias("answer"))
    a = a.withColumn("question", F.when(F.col("answer_id") % 7 == 0, VAGUE).otherwise("Who came?"))
    e = c.where("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("n"))
    p = store.materialise(_claim_pairs(spark, d))
    m = p.groupBy("answer_id").agg(F.max("entailment").alias("sim"))
    rep = grounding.answer_report(grounding.claim_status(p)).select("answer_id", "claims", "overall")
    # evidence of another document among every eleventh answer's
    used = p.select("answer_id", F.when((F.col("answer_id") % 11 == 0) & (F.col("claim_index") == 0), -F.col("conv_id") - 1).otherwise(F.col("conv_id")).alias("document_id"))
    iso = grounding.isolation(used, F.floor(F.col("answer_id") / 100)).select("answer_id", "isolated")
    j = a.join(e, "conv_id", "left").join(m, "answer_id", "left").join(rep, "answer_id", "left").join(iso, "answer_id", "left")
    j = j.withColumn("ambiguous", planner.classify(planner.normalise(F.col("question")))["type"] == "ambiguous").withColumn("n_evidence", F.coalesce("n", F.lit(0))).withColumn("max_similarity", F.coalesce("sim", F.lit(0.0)))
    j = j.withColumn("isolated", F.coalesce("isolated", F.lit(True))).withColumn("completeness", F.lit("complete"))
    return j.select("answer_id", grounding.policy(True).alias("outcome"))


GROUNDED_MARKS = f"""x AS (SELECT conv_id * 100 + turn AS query_id, (conv_id * 100 + turn) % 3 <> 0 AS answerable, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS expected, role FROM conversations),
c AS (SELECT answer_id, list(DISTINCT evidence_rank) FILTER (entailment >= 0.2) AS cited, list(DISTINCT evidence_rank) FILTER (evidence_rank < 4) AS relevant FROM pairs GROUP BY answer_id),
b AS (SELECT x.*, coalesce(r.overall, 'empty') AS status, coalesce(r.claims, 0) AS claims, coalesce(r.supported, 0) AS supported, coalesce(r.contradicted, 0) AS contradicted, coalesce(c.cited, []) AS cited, coalesce(c.relevant, []) AS relevant, {BARE.format(c='answer')} AS ax, {BARE.format(c="coalesce(expected, '')")} AS ex
  FROM x LEFT JOIN rep r ON r.answer_id = x.query_id LEFT JOIN c ON c.answer_id = x.query_id WHERE x.role = 'assistant'),
f AS (SELECT *, status IN ('insufficient_evidence', 'ungrounded', 'contradicted') OR coalesce(answer, '') = '' OR regexp_matches(lower(coalesce(answer, '')), 'cannot answer|insufficient evidence|not provided|not mentioned|no evidence|unanswerable|cannot determine|out of scope') OR (NOT answerable AND supported = 0) AS refused,
  list_sum(list_transform(list_distinct(ax), lambda t: least(len(list_filter(ax, lambda v: v = t)), len(list_filter(ex, lambda v: v = t))))) AS common FROM b),
g AS (SELECT *, round(CASE WHEN NOT answerable THEN CASE WHEN refused THEN 1.0 ELSE 0.0 END WHEN coalesce(expected, '') <> '' AND NOT refused AND coalesce(common, 0) > 0 THEN 2.0 * common / (len(ax) + len(ex)) ELSE 0.0 END, 4) AS f1 FROM f)
SELECT query_id, answerable, status, CAST(len(cited) AS INTEGER) AS citations, refused, answerable <> refused AS refusal_correct, answerable AND refused AS false_refusal, NOT answerable AND NOT refused AS incorrect_answer, f1,
  CASE WHEN answerable THEN coalesce(expected, '') <> '' AND NOT refused AND f1 >= 0.35 ELSE refused END AS correct, answerable AND NOT refused AND status = 'grounded' AND contradicted = 0 AND supported > 0 AS success,
  CASE WHEN claims > 0 THEN round(supported / claims, 4) WHEN answerable THEN 0.0 ELSE 1.0 END AS support_rate,
  CASE WHEN NOT answerable THEN CASE WHEN len(cited) = 0 THEN 1.0 ELSE 0.0 END WHEN len(cited) = 0 THEN 0.0 WHEN len(relevant) = 0 THEN 1.0 ELSE round(len(list_intersect(cited, relevant)) / len(cited), 4) END AS citation_precision,
  CASE WHEN NOT answerable THEN CASE WHEN len(cited) = 0 THEN 1.0 ELSE 0.0 END WHEN len(relevant) = 0 THEN 1.0 ELSE round(len(list_intersect(cited, relevant)) / len(relevant), 4) END AS citation_recall FROM g"""


def graded_answers(spark, d) -> DataFrame:
    """evaluation.grounded_results' input: assistants' turns as answers, the turn before as what was expected."""
    c = read(spark, d, "conversations")
    x = c.withColumn("expected", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("answer"), "expected")
    p = store.materialise(_claim_pairs(spark, d))
    rep = grounding.answer_report(grounding.claim_status(p)).select(F.col("answer_id").alias("query_id"), F.col("overall").alias("status"), "claims", "supported", "unsupported", "contradicted", "conflicted")
    cited = p.groupBy(F.col("answer_id").alias("query_id")).agg(F.collect_set(F.when(F.col("entailment") >= 0.2, F.col("evidence_rank"))).alias("cited"), F.collect_set(F.when(F.col("evidence_rank") < 4, F.col("evidence_rank"))).alias("relevant"))
    none = F.array().cast("array<bigint>")
    j = x.join(rep, "query_id", "left").join(cited, "query_id", "left").withColumn("answerable", F.col("query_id") % 3 != 0)
    j = j.withColumns({"status": F.coalesce("status", F.lit("empty")), **{n: F.coalesce(n, F.lit(0)) for n in ("claims", "supported", "unsupported", "contradicted", "conflicted")}, "cited": F.coalesce("cited", none), "relevant": F.coalesce("relevant", none)})
    return j


def _grounded_results(spark, d) -> DataFrame:
    return evaluation.grounded_results(graded_answers(spark, d))


@query(f"WITH {STATUS}, {REPORT}, {GROUNDED_MARKS}")
def grounding_evaluation(spark, d):
    return _grounded_results(spark, d)


@query(f"""WITH m AS (WITH {STATUS}, {REPORT}, {GROUNDED_MARKS}), g AS (SELECT count(*) AS queries, count(*) FILTER (answerable) AS a, count(*) FILTER (NOT answerable) AS u, count(*) FILTER (NOT answerable AND refused) AS r, count(*) FILTER (false_refusal) AS f, count(*) FILTER (incorrect_answer) AS w, count(*) FILTER (NOT answerable AND citations > 0) AS l,
  count(*) FILTER (NOT answerable AND refused AND citations = 0) AS s FROM m)
SELECT queries, round(r / u, 4) AS refusal_precision, round(f / a, 4) AS false_refusal_rate, round(w / u, 4) AS incorrect_rate, round(s / u, 4) AS safe_refusal_rate, round(1 - l / u, 4) AS no_leak_rate, CASE WHEN w > 0 THEN 'FAIL' WHEN r / u < 1 OR f / a > 0.1 THEN 'WARNING' ELSE 'PASS' END AS status FROM g""")
def safety_evaluation(spark, d):
    return evaluation.safety_summary(evaluation.safety_marks(_grounded_results(spark, d)))


@query(f"""WITH m AS (WITH {STATUS}, {REPORT}, {GROUNDED_MARKS}) SELECT query_id, CASE WHEN answerable THEN CASE WHEN NOT false_refusal AND status = 'grounded' THEN 'PASS' ELSE 'WARNING' END WHEN refused AND citations = 0 THEN 'PASS' WHEN incorrect_answer THEN 'FAIL' ELSE 'WARNING' END AS verdict, NOT answerable AND citations > 0 AS leaked FROM m""")
def safety_verdicts(spark, d):
    return evaluation.safety_marks(_grounded_results(spark, d)).select("query_id", "verdict", "leaked")


@query("""WITH g AS (SELECT conv_id AS query_id, coalesce(list(DISTINCT turn // 2) FILTER (role = 'user'), []) AS required, coalesce(list(DISTINCT turn // 2) FILTER (turn < 6), []) AS retrieved, coalesce(list(DISTINCT turn // 2) FILTER (role = 'assistant'), []) AS cited, count(*) AS n FROM conversations GROUP BY conv_id),
r AS (SELECT query_id, len(list_filter(required, lambda x: NOT list_contains(retrieved, x))) = 0 AS all_retrieved, CASE WHEN len(required) = 0 THEN 1.0 ELSE round(len(list_intersect(required, retrieved)) / len(required), 4) END AS coverage, n % 5 <> 0 AND (n % 4) / 4.0 >= 0.25 AND query_id % 6 <> 0 AS synthesis,
  query_id % 3 = 0 OR query_id % 6 = 0 AS unsupported_information, len(list_filter(required, lambda x: NOT list_contains(cited, x))) = 0 AS all_cited, CASE WHEN len(required) = 0 THEN 1.0 ELSE round(len(list_intersect(required, cited)) / len(required), 4) END AS citation_coverage FROM g)
SELECT *, CASE WHEN all_retrieved AND synthesis AND NOT unsupported_information AND all_cited THEN 'PASS' WHEN all_retrieved AND synthesis THEN 'WARNING' ELSE 'FAIL' END AS verdict FROM r""")
def multipage_synthesis(spark, d):
    page = F.floor(F.col("turn") / 2)
    some = lambda e, n: F.collect_set(F.when(e, page)).alias(n)
    g = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(some(F.col("role") == "user", "required"), some(F.col("turn") < 6, "retrieved"), some(F.col("role") == "assistant", "cited"), F.count("*").alias("n"))
    q, n = F.col("query_id"), F.col("n")
    return evaluation.multipage_synthesis(g.withColumns({"refused": n % 5 == 0, "support_rate": (n % 4) / 4.0 + 0.5, "unsupported": F.when(q % 3 == 0, 1).otherwise(0), "contradicted": F.when(q % 6 == 0, 1).otherwise(0)}))


@query(f"""WITH t AS (SELECT item_id, text, list_filter({TOKENS.format(c='text')}, lambda x: length(x) > 4) AS w FROM benchmark), p AS (SELECT item_id, text, w[1] AS a, w[-1] AS b, substr(text, 1, length(text) // 2) AS half FROM t WHERE len(w) > 0),
m AS (SELECT *, a = b OR (contains(lower(half), a) AND contains(lower(half), b)) AS first_ok, contains(lower(text), a) AND contains(lower(text), b) AS second_ok, item_id % 4 = 0 AS no_second FROM p)
SELECT item_id, CASE WHEN first_ok THEN 'complete' WHEN no_second THEN 'incomplete_attempt_1' WHEN second_ok THEN 'complete' ELSE 'incomplete_after_retry' END AS completeness, NOT first_ok AS regenerated, CASE WHEN first_ok OR no_second THEN length(trim(half)) ELSE length(trim(text)) END AS chars FROM m""")
def answer_retry(spark, d):
    w = F.filter(T.tokens(F.col("text")), lambda x: F.length(x) > 4)
    b = read(spark, d, "benchmark").withColumn("w", w).where(F.size("w") > 0).withColumns({"query": F.concat(F.lit("Compare "), F.element_at("w", 1), F.lit(" and "), F.element_at("w", -1)), "first_answer": F.expr("substring(text, 1, cast(length(text) div 2 as int))"), "second_answer": F.when(F.col("item_id") % 4 != 0, F.col("text"))})
    return grounding.answered(planner.plan(b)).select("item_id", "completeness", "regenerated", F.length("answer").cast("bigint").alias("chars"))


@query(f"""WITH q AS (SELECT conv_id, first(text ORDER BY turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id), e AS (SELECT conv_id, turn, text, {CONTENT.format(c='text')} AS et FROM conversations WHERE role = 'assistant' AND conv_id % 5 <> 0),
s AS (SELECT conv_id, turn, text, len(list_intersect({CONTENT.format(c='question')}, et)) AS n FROM q JOIN e USING (conv_id)), b AS (SELECT conv_id, first(text ORDER BY n DESC, turn) AS text, max(n) AS n FROM s GROUP BY conv_id)
SELECT conv_id AS query_id, nullif(trim(CASE WHEN n > 0 THEN text END), '') AS answer, nullif(trim(CASE WHEN n > 0 THEN text END), '') IS NOT NULL AS answerable, CASE WHEN n IS NULL THEN 'no_evidence' WHEN nullif(trim(CASE WHEN n > 0 THEN text END), '') IS NULL THEN 'no_answer' END AS reason FROM q LEFT JOIN b USING (conv_id)""")
def generated_answers(spark, d):
    c = read(spark, d, "conversations")
    q = c.where("role = 'user'").groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("question"))
    found = c.where("role = 'assistant' and conv_id % 5 <> 0").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("text").alias("source_text"))
    e = evidence.evidence_items(found).join(q, "query_id")
    n = F.size(F.array_intersect(T.content_tokens(F.col("question")), T.content_tokens(F.col("text"))))
    best = e.withColumn("n", n).groupBy("query_id").agg(F.max_by(F.struct("text", "n"), F.struct("n", -F.col("rank"))).alias("best"), F.concat_ws(" ", F.collect_list("text")).alias("context"))
    return evidence.generate(q, best, F.when(F.col("best.n") > 0, F.col("best.text"))).select("query_id", "answer", "answerable", "reason")


@query("SELECT doc_id, 'doc_' || substr(sha256(text), 1, 16) AS content_id FROM documents")
def content_document_id(spark, d):
    return read(spark, d, "documents").select("doc_id", T.content_id(F.col("text")).alias("content_id"))


@query(r"SELECT conv_id AS document_id, turn + 1 AS page_number, CAST(coalesce(length(text), 0) AS INTEGER) AS char_count, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS INTEGER) AS word_count, CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 'empty' WHEN length(trim(coalesce(text, ''))) < 50 THEN 'low_text' END AS warning FROM conversations")
def page_counts(spark, d):
    from folio.sources.files import page_rows

    return page_rows(pages(spark, d)).select("document_id", F.col("page_number").cast("bigint").alias("page_number"), "char_count", "word_count", "warning")


@query(r"SELECT conv_id AS document_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (length(trim(text)) < 50) AS low_text FROM conversations GROUP BY conv_id")
def document_totals(spark, d):
    n = F.length(F.trim("text"))
    return pages(spark, d).groupBy("document_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"), F.count_if(n < 50).alias("low_text"))


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 20 OFFSET 40")
def list_documents_paged(spark, d):
    return store.page_of(read(spark, d, "documents"), "n_chars", "doc_id", 40, 20).select("doc_id", "source", "n_chars")


@query("SELECT conv_id AS document_id, CAST(turn + 1 AS INTEGER) AS page_number, text FROM conversations WHERE conv_id = 7 ORDER BY turn")
def pages_of_document(spark, d):
    return pages(spark, d).where("document_id = 7").orderBy("page_number").select("document_id", "page_number", "text")


@query("SELECT source, count(*) AS documents, count(*) FILTER (vec_id IS NOT NULL) AS embedded FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY source")
def chunk_counts(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("e"))
    return read(spark, d, "documents").join(v, "doc_id", "left").groupBy("source").agg(F.count("*").alias("documents"), F.count("e").alias("embedded"))


@query("SELECT 'documents' AS name, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def cascade_delete(spark, d):
    docs, lab = read(spark, d, "documents"), read(spark, d, "labels")
    left = store.without_documents({"documents": docs, "labels": lab}, lab.where("toxic = 1"), "doc_id")
    count = lambda n: left[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return count("documents").unionByName(count("labels"))


@query("SELECT user_id AS document_id, max_by(event_type, (ts, event_id)) AS status, count(*) AS changes FROM events GROUP BY user_id")
def status_log(spark, d):
    e = read(spark, d, "events")
    log = e.select(F.col("user_id").alias("document_id"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("status"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("error"))
    return store.current_status(log).select("document_id", "status").join(e.groupBy(F.col("user_id").alias("document_id")).agg(F.count("*").alias("changes")), "document_id")


@query("""WITH p AS (SELECT conv_id, turn AS page FROM conversations UNION ALL SELECT conv_id, turn FROM conversations WHERE turn = 2 AND conv_id % 4 = 0), k AS (SELECT conv_id, turn + CASE WHEN conv_id % 9 = 0 THEN 100 ELSE 0 END AS page, turn - 1 AS i FROM conversations UNION ALL SELECT conv_id, turn, turn - 1 FROM conversations WHERE turn = 3 AND conv_id % 9 <> 0)
SELECT 'document_id unique' AS rule, (SELECT count(*) FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 10 = 1) AS n UNION ALL SELECT 'page unique', (SELECT count(*) FROM (SELECT 1 FROM p GROUP BY conv_id, page HAVING count(*) > 1)) UNION ALL SELECT 'chunk unique', (SELECT count(*) FROM (SELECT 1 FROM k GROUP BY conv_id, page, i HAVING count(*) > 1))
UNION ALL SELECT 'page has document', (SELECT count(*) FROM p WHERE conv_id % 10 = 3) UNION ALL SELECT 'chunk has page', (SELECT count(*) FROM k WHERE (conv_id, page) NOT IN (SELECT (conv_id, page) FROM p)) UNION ALL SELECT 'page_number from 1', (SELECT count(*) FROM p WHERE page < 1) UNION ALL SELECT 'chunk_index from 0', (SELECT count(*) FROM k WHERE i < 0)""")
def integrity_violations(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"))
    docs = c.select("document_id").distinct().where("document_id % 10 <> 3")
    k = c.select("document_id", (F.col("page_number") + F.when(F.col("document_id") % 9 == 0, 100).otherwise(0)).alias("page_number"), (F.col("page_number") - 1).alias("chunk_index"))
    again = c.where("page_number = 3 and document_id % 9 <> 0").withColumn("chunk_index", F.col("page_number") - 1)
    return store.violations(docs.unionByName(docs.where("document_id % 10 = 1")), c.unionByName(c.where("page_number = 2 and document_id % 4 = 0")), k.unionByName(again))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\x0B\f\r\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS cleaned FROM documents")
def clean_white_space(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.horizontal(T.line_endings(F.col("text")))).alias("cleaned"))


@query()
def clean_text(spark, d):
    return read(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("text"))


@query()
def split_sentences(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("at", "sentence"))


@query()
def chunk_pages(spark, d):
    return chunking.chunk_pages(pages(spark, d))


@query()
def chunk_documents(spark, d):
    return chunking.chunk_pages(read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), "text"))


@query("SELECT CAST(conv_id AS VARCHAR) AS document_id, count(*) FILTER (trim(text) <> '') AS pages, true AS contiguous, true AS in_order, true AS named FROM conversations GROUP BY conv_id")
def chunk_numbering(spark, d):
    c = chunking.chunk_pages(pages(spark, d)).withColumn("before", F.lag("page_number").over(Window.partitionBy("document_id").orderBy("chunk_index")))
    named = F.col("chunk_id") == F.format_string("%s_p%03d_c%04d", "document_id", "page_number", "chunk_index")
    return c.groupBy("document_id").agg(F.count_distinct("page_number").alias("pages"), ((F.min("chunk_index") == 0) & (F.max("chunk_index") == F.count("*") - 1) & (F.count_distinct("chunk_index") == F.count("*"))).alias("contiguous"), F.bool_and(F.coalesce("before", F.lit(0)) <= F.col("page_number")).alias("in_order"), F.bool_and(named).alias("named"))


#: Questions made of words of every benchmark item; a blank one is left out of the plans.
ASKING = (
    "What is {a}?", "Compare {a} and {b} in 2017", "Who wrote chapter 3 of {a}?", "How many {a} are on pages 10 to 12?", "Why does {a} occur?", "What are the causes and effects of {a}?", "Explain {a}, and how does {b} scale?", "List the types of {a}",
    "When was {a} released?", "Where is {a}?", "Summarize {a}", "What is the single best {a}?", "How do {a} relate to {b} metrics, and what trade-offs are there?", "Who was the mother of the founder of {a}?", "Which chapter covers {a}?",
    "What is the formula for {a}?", "{a} vs {b}", "What is the difference between the {a} and a {b} in terms of cost?", "How to build {a}", "How does {a} work?", "Which {a} won? And {b}?", "{a} {b}", "How do {a} perform?", "See page 7 about '{a} {b}'", "   ",
)
ASKED_SQL = "f AS (SELECT i, t FROM (VALUES " + ", ".join(f"({i}, '{t.replace(chr(39), chr(39) * 2)}')" for i, t in enumerate(ASKING)) + f") v(i, t)), w AS (SELECT item_id, list_filter({TOKENS.format(c='text')}, lambda x: length(x) > 2) AS w FROM benchmark), q AS (SELECT item_id * 100 + i AS id, trim(replace(replace(t, '{{a}}', w[1]), '{{b}}', w[-1])) AS q FROM w, f WHERE len(w) > 0 AND trim(t) <> '')"


def _plans(spark, d) -> DataFrame:
    w = read(spark, d, "benchmark").select("item_id", F.filter(T.tokens(F.col("text")), lambda x: F.length(x) > 2).alias("w")).where(F.size("w") > 0)
    t = w.select("item_id", "w", F.posexplode(F.array(*[F.lit(t) for t in ASKING])).alias("i", "t"))
    q = t.select((F.col("item_id") * 100 + F.col("i")).alias("id"), F.replace(F.replace("t", F.lit("{a}"), F.element_at("w", 1)), F.lit("{b}"), F.element_at("w", -1)).alias("query"))
    return planner.plan(q)


def _rules_sql(column: int) -> str:
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    fits = lambda needed, barred: " AND ".join([f"regexp_matches(lower(q), {quote(p)})" for p in needed] + ([f"NOT regexp_matches(lower(q), {quote(barred)})"] if barred else []))
    return "CASE " + " ".join(f"WHEN {fits(r[2], r[3])} THEN '{r[column]}'" for r in planner.RULES) + f" ELSE '{('unknown', 'explanation')[column]}' END"


@query(f"WITH {ASKED_SQL} SELECT id, {_rules_sql(0)} AS type, {_rules_sql(1)} AS answer_type FROM q")
def query_plan_types(spark, d):
    return _plans(spark, d).select("id", "class.type", F.col("class.answer").alias("answer_type"))


_whole = lambda p, g: f"coalesce(TRY_CAST(nullif(regexp_extract(q, '{p}', {g}), '') AS INTEGER), 0)"
_range = r"(?i)\bpages?\s+(\d+)\s*(?:-|to)\s*(\d+)\b"


@query(rf"""WITH {ASKED_SQL} SELECT id, {_whole(r'(?i)\b(?:chapter|ch\.?)\s+(\d+)\b', 1)} AS chapter, CASE WHEN regexp_matches(q, '{_range}') THEN 0 ELSE {_whole(r'(?i)\bpages?\s+(\d+)\b', 1)} END AS page, least({_whole(_range, 1)}, {_whole(_range, 2)}) AS page_from,
greatest({_whole(_range, 1)}, {_whole(_range, 2)}) AS page_to, {_whole(r'\b(1[89]\d\d|20\d\d)\b', 1)} AS year, array_to_string(regexp_extract_all(q, '["'']([^"'']{{2,}})["'']', 1), '|') AS quoted FROM q""")
def query_plan_constraints(spark, d):
    return _plans(spark, d).select("id", *[F.coalesce(f"constraints.{c}", F.lit(0)).alias(c) for c in ("chapter", "page", "page_from", "page_to", "year")], F.array_join("constraints.quoted", "|").alias("quoted"))


_side = lambda p, g: rf"trim(regexp_replace(regexp_replace(trim(regexp_extract(q, '{p}', {g})), '[?.!]+$', ''), '(?i)^(?:the|a|an)\s+', ''))"


@query(rf"""WITH {ASKED_SQL}, k AS (SELECT *, {_rules_sql(0)} AS type, regexp_replace(q, '[?.!]+$', '') AS bare FROM q),
x AS (SELECT *, """ + ", ".join(f"[{_side(p, 1)}, {_side(p, 2)}] AS s{i}, regexp_matches(q, '{p}') AND {_side(p, 1)} <> '' AND {_side(p, 2)} <> '' AND lower({_side(p, 1)}) <> lower({_side(p, 2)}) AS ok{i}" for i, p in enumerate(planner.ASPECTS)) + r""",
  list_filter(list_transform(regexp_split_to_array(q, '(?i),?\s*\band\s+(?:how|what|why|which|where)\b'), lambda p: trim(regexp_replace(regexp_replace(trim(p), '[?.!]+$', ''), '(?i)^(?:and|how|what|why|which|where)\s+', ''))), lambda p: length(p) > 3) AS parts,
  list_transform(list_filter(string_split(q, '?'), lambda p: trim(p) <> ''), lambda p: regexp_replace(trim(p), '[?.!]+$', '')) AS marks, regexp_extract(q, '(?i)(?:causes?\s+and\s+(?:consequences?|effects?|impacts?)|(?:consequences?|effects?|impacts?)\s+and\s+causes?)\s+(?:of\s+)?(.+?)(?:\?|\.|$)', 1) AS target FROM k),
y AS (SELECT *, CASE WHEN type = 'comparison' THEN CASE WHEN ok0 THEN s0 WHEN ok1 THEN s1 WHEN ok2 THEN s2 END END AS sides, CASE WHEN regexp_matches(q, '\b(1[89]\d\d|20\d\d)\b') THEN ' ' || regexp_extract(q, '\b(1[89]\d\d|20\d\d)\b') ELSE '' END AS yr,
  CASE WHEN type IN ('multi_part', 'multi_page') THEN CASE WHEN len(parts) >= 2 THEN parts WHEN len(marks) >= 2 THEN marks END END AS several FROM x)
SELECT id, CASE WHEN sides IS NOT NULL THEN sides[1] || yr || '|' || sides[2] || yr WHEN several IS NOT NULL THEN several[1] || '|' || several[2] WHEN type IN ('causal', 'list', 'factual') AND target <> '' THEN 'causes of ' || target || '|consequences of ' || target ELSE bare END AS searches FROM y""")
def query_plan_searches(spark, d):
    return _plans(spark, d).select("id", F.array_join("retrieval_queries", "|").alias("searches"))


@query(rf"""WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS source FROM conversations), n AS (SELECT *, {PLAIN.replace('lower({c})', '{c}').format(c='text')} AS plain FROM t WHERE source IS NOT NULL)
SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(plain, '\b([A-Z][a-z]{{2,}})\b', 1), lambda x: NOT list_contains({_list(question_checks.QUESTION_STARTS)}, x) AND NOT contains(lower(source), lower(x))), ',') AS outside FROM n""")
def outside_names(spark, d):
    c = read(spark, d, "conversations").withColumn("source", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("source is not null")
    return c.select("conv_id", "turn", F.array_join(question_checks.outside_names(F.col("text"), F.col("source")), ",").alias("outside"))


_words = "list_filter(regexp_split_to_array(text, '[\\s\\x0B\\x{{0085}}\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda x: x <> '')".format()


@query(rf"""WITH t AS (SELECT doc_id, text, {_words} AS w, list_filter(regexp_extract_all(lower(text), '([\p{{L}}\p{{N}}_]+)', 1), lambda x: NOT list_contains({_list(T.ELIGIBILITY_STOPS)}, x)) AS c FROM documents)
SELECT doc_id, CAST(len(w) AS INTEGER) AS words, CAST(len(list_filter(list_transform(regexp_split_to_array(text, '[,;]'), lambda x: trim(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda x: regexp_matches(x, '{questions.NAME.replace("'", "''")}'))) AS INTEGER) AS names,
round(len(list_filter(w, lambda x: regexp_matches(x, '^[A-Za-z][A-Za-z''\-]{{2,}}[.,;:]?$'))) / greatest(len(w), 1), 6) AS alpha, round(len(list_filter(c, lambda x: length(x) > 5)) / greatest(len(c), 1), 6) AS density,
CAST(len(list_distinct(list_transform(regexp_extract_all(text, '(?i)\b({questions.PUBLISHING})\b', 1), lambda x: lower(x)))) AS INTEGER) AS publishing FROM t""")
def eligibility_features(spark, d):
    return questions.measured(read(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "words", "names", "alpha", "density", "publishing")


@query()
def eligible_chunks(spark, d):
    return questions.eligible(read(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "category", "reason", "eligible", "density")


@query()
def answer_candidates(spark, d):
    return candidates.answer_candidates(chunk_documents(spark, d)).drop("text")


KEYED = r"list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(trim({c})), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> ''))"
ASKED_WORDS = f"CASE WHEN len(list_filter({KEYED}, lambda x: NOT list_contains({{stops}}, x))) > 0 THEN list_filter({KEYED}, lambda x: NOT list_contains({{stops}}, x)) ELSE {KEYED} END"


@query(f"""WITH s AS (SELECT t, min(doc_id) AS id FROM (SELECT doc_id, list_sort({ASKED_WORDS.format(c='text', stops=_list(T.QUESTION_STOPS))}) AS t FROM documents) WHERE len(t) > 0 GROUP BY t),
w AS (SELECT id, unnest(t) AS x FROM s), n AS (SELECT id, len(t) AS k FROM s), c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM w a JOIN w b ON a.x = b.x AND a.id < b.id GROUP BY ALL)
SELECT a, b, round(c / (p.k + q.k - c), 6) AS jaccard FROM c JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE round(c / (p.k + q.k - c), 6) >= 0.88""")
def jaccard_pairs(spark, d):
    return questions.jaccard_pairs(read(spark, d, "documents"), "doc_id", T.question_tokens(F.col("text")))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, doc_id = min(doc_id) OVER (PARTITION BY text) AS kept FROM documents")
def exact_dedup(spark, d):
    return questions.exact_groups(read(spark, d, "documents"), F.col("text"), "doc_id")


@query()
def greedy_neardup(spark, d):
    return questions.greedy_neardup(read(spark, d, "documents"), "doc_id", F.col("text"), T.content_tokens(F.col("text")))


@query("""WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS turn_no, min(turn) OVER (PARTITION BY conv_id, role) AS f FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_no, f, turn) AS pick FROM t) SELECT conv_id, turn, role, CAST(pick AS INTEGER) AS pick FROM p WHERE pick <= 4""")
def diversity_round_robin(spark, d):
    return ranking.round_robin(read(spark, d, "conversations"), "conv_id", "role", "turn", 4).select("conv_id", "turn", "role", "pick")


LOGITS = "CAST(({m} * (token + 1) * (query_id + 3) + {a} * win) % 97 AS DOUBLE) / 10"


@query(f"""WITH l AS (SELECT vec_id AS query_id, w AS win, k AS token FROM embeddings, range(2) a(w), range(40) b(k) WHERE vec_id % 100 = 0),
x AS (SELECT *, {LOGITS.format(m=31, a=7)} AS s0, {LOGITS.format(m=17, a=5)} AS e0 FROM l),
s AS (SELECT query_id, win, token AS s, s0 FROM (SELECT *, row_number() OVER (PARTITION BY query_id, win ORDER BY s0 DESC, token) AS r FROM x WHERE token > 0) WHERE r <= 20),
e AS (SELECT query_id, win, token AS e, e0 FROM (SELECT *, row_number() OVER (PARTITION BY query_id, win ORDER BY e0 DESC, token) AS r FROM x WHERE token > 0) WHERE r <= 20),
nul AS (SELECT query_id, win, s0 + e0 AS n FROM x WHERE token = 0), p AS (SELECT query_id, win, s, e, s0 + e0 AS score, s0 + e0 - n AS diff FROM s JOIN e USING (query_id, win) JOIN nul USING (query_id, win) WHERE s <= e AND e < s + 64),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY diff DESC, score DESC, win, s, e) AS r FROM p)
SELECT query_id, diff > 0 AS answerable, CASE WHEN diff > 0 THEN win END AS win, CASE WHEN diff > 0 THEN s END AS start_token, CASE WHEN diff > 0 THEN e END AS end_token, round(score, 4) AS score, round(diff, 4) AS score_diff FROM b WHERE r = 1""")
def span_best(spark, d):
    q = read(spark, d, "embeddings").where(ASKED).select(F.col("vec_id").alias("query_id"))
    rows = q.select("query_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("window")).select("query_id", "window", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(39).cast("bigint"))).alias("token"))
    value = lambda m, a: ((F.lit(m) * (F.col("token") + 1) * (F.col("query_id") + 3) + F.lit(a) * F.col("window")) % 97).cast("double") / 10
    return qa.best_span(rows.withColumn("start", value(31, 7)).withColumn("end", value(17, 5))).withColumnRenamed("window", "win")


@query(f"""WITH t AS (SELECT item_id, text, {TERMS.format(c='text', n=0, stops=_list(T.COMPLETENESS_STOPS))} AS t FROM benchmark), p AS (SELECT item_id, text, t[1] || ' ' || t[2] AS a, t[2] || ' ' || t[-1] AS b, substr(text, 1, length(text) // 2) AS half, t[1] AS t1, t[2] AS t2, t[-1] AS t9 FROM t WHERE len(t) > 2)
SELECT item_id AS id, contains(lower(half), a) OR CASE WHEN t1 NOT IN (t2, t9) THEN contains(lower(half), t1) ELSE (length(t1) > 2 AND contains(lower(half), t1)) OR (length(t2) > 2 AND contains(lower(half), t2)) END AS first,
  contains(lower(half), b) OR CASE WHEN t9 NOT IN (t1, t2) THEN contains(lower(half), t9) ELSE (length(t9) > 2 AND contains(lower(half), t9)) OR (length(t2) > 2 AND contains(lower(half), t2)) END AS second FROM p""")
def completeness_check(spark, d):
    t = T.terms(F.col("text"), T.COMPLETENESS_STOPS, 0)
    found = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b([a-zA-Z0-9+\-*]+)\b"), F.lit(1)), lambda x: ~x.isin(*T.COMPLETENESS_STOPS))
    b = read(spark, d, "benchmark").withColumn("t", found).where((F.size("t") > 2) & (F.size(t) >= 0))
    b = b.select("item_id", F.concat_ws(" ", F.element_at("t", 1), F.element_at("t", 2)).alias("a"), F.concat_ws(" ", F.element_at("t", 2), F.element_at("t", -1)).alias("b"), F.expr("substring(text, 1, cast(length(text) div 2 as int))").alias("half"))
    a, b_, h = F.col("a"), F.col("b"), F.col("half")
    return b.select(F.col("item_id").alias("id"), grounding.aspect_covered(a, b_, h).alias("first"), grounding.aspect_covered(b_, a, h).alias("second"))


@query("SELECT source, count(*) AS documents, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY source")
def report_round_trip(spark, d):
    import uuid

    path = f"{store.scratch(spark)}/report-{uuid.uuid4().hex}"
    t = read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))
    reports.write_report("Documents", {"sources": t}, path)
    return spark.read.schema(t.schema).json(f"{path}/sources.json")


@query()
def stream_ingest_idempotent(spark, d):
    import uuid

    from folio.streaming.ingest import committed, ingest

    root = f"{store.scratch(spark)}/ingest-{uuid.uuid4().hex}"
    pages(spark, d).select(F.coalesce("text", F.lit("")).alias("text")).write.text(f"{root}/landing")
    for _ in range(2):
        ingest(spark, f"{root}/landing", f"{root}/out", f"{root}/offsets")
    return committed(spark, f"{root}/out", "chunks").select("document_id", "page_number", "chunk_index", "chunk_id", "char_count")
