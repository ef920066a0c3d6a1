"""Search by text, batch scorers and grounded answers as queries, with SQL.

The models are deterministic stand-ins that SQL can tell: hashed embeddings, overlaps of content words. Chunks are the turns of
conversations (vec_id: conv_id * 100 + turn; label: conv_id), question texts are benchmark items. Every eleventh conversation's turns bear
the next one's document_id, so that answers from it are not of the document asked.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import text as T
from folio.operators import answering, embedding, evidence, grounding, qa, ranking, search, store
from folio.operators.store import materialise
from folio.plans import catalog, stand_ins
from folio.plans.catalog import CONTENT, FORM, REFS, STATUS, TERMS, TOKENS, _list, stated
from folio.plans.registry import query, read

DIMENSION = embedding.DIMENSION


def chunks(spark, d) -> DataFrame:
    c = read(spark, d, "conversations").where("trim(coalesce(text, '')) <> ''")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("vec_id"), F.col("conv_id").alias("label"), F.when(F.col("conv_id") % 11 == 10, F.col("conv_id") + 1).otherwise(F.col("conv_id")).cast("string").alias("document_id"), (F.col("turn") + 1).cast("int").alias("page_number"), "role", "text")


def indexed(spark, d) -> DataFrame:
    """chunks with the vectors of an index that is built from their texts, saved and loaded again."""
    c = chunks(spark, d)
    path = f"{store.scratch(spark)}/text-index-{uuid.uuid4().hex}"
    index = embedding.build_index(c.select("vec_id", "text"), embedding.hash_embedder(), DIMENSION, path)
    return c.join(index.select("vec_id", "embedding"), "vec_id")


#: Hashed embeddings of t (id, text): e (id, v), v of unit length as 32-bit floats; a text without tokens is a zero vector.
EMBEDDED = f"""{{e}}_p AS (SELECT id, CAST('0x' || substr(h, 1, 8) AS BIGINT) % {DIMENSION} AS place, CASE WHEN CAST('0x' || substr(h, 9, 1) AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END AS sign FROM (SELECT id, md5(unnest({TOKENS.format(c='text')})) AS h FROM {{t}})),
{{e}}_s AS (SELECT id, place, CAST(sum(sign) AS DOUBLE) AS x FROM {{e}}_p GROUP BY id, place),
{{e}}_n AS (SELECT id, sqrt(sum(x * x)) AS n FROM {{e}}_s GROUP BY id),
{{e}} AS (SELECT t.id, list(CAST(coalesce(x / nullif(n, 0), 0) AS FLOAT) ORDER BY k) AS v FROM {{t}} t CROSS JOIN range({DIMENSION}) r(k) LEFT JOIN {{e}}_s s ON s.id = t.id AND s.place = k LEFT JOIN {{e}}_n n ON n.id = t.id GROUP BY t.id)"""
CHUNKS = "ch AS (SELECT conv_id * 100 + turn AS id, conv_id, turn, role, text FROM conversations WHERE trim(coalesce(text, '')) <> '')"
NEAR = "round(greatest(-1.0, least(1.0, list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])))), 6)"


@query(f"""WITH {CHUNKS}, bq AS (SELECT item_id AS id, text FROM benchmark), {EMBEDDED.format(e='ce', t='ch')}, {EMBEDDED.format(e='qe', t='bq')},
s AS (SELECT qe.id AS query_id, ce.id AS vec_id, {NEAR.format(a='qe.v', b='ce.v')} AS score FROM qe, ce)
SELECT query_id, vec_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5""")
def search_by_text(spark, d):
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return embedding.search_texts(indexed(spark, d), asked, embedding.hash_embedder(), 5)


@query(f"""WITH {CHUNKS}, {EMBEDDED.format(e='ce', t='ch')}, q AS (SELECT v FROM ce JOIN ch USING (id) WHERE conv_id = 0 AND turn = 0),
s AS (SELECT ce.id AS vec_id, {NEAR.format(a='ce.v', b='q.v')} AS score FROM q, ce JOIN ch USING (id) WHERE conv_id = 0)
SELECT vec_id, score, rank AS original_rank, CAST(NULL AS DOUBLE) AS new_score, rank FROM (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10""")
def search_text_in_document(spark, d):
    index = materialise(indexed(spark, d))
    registry = search.Registry()
    registry.add("turns", search.Index(index))
    return embedding.search_text(registry, index.where("vec_id = 0").first().text, embedding.hash_embedder(), 10, document_id="0")


#: What is asked of a turn by a user, by (7 conv_id + turn) modulo their number: a and b are its first and last words of over four letters.
#: Five are asked of the turn's own conversation, one of all, one of a conversation that isn't there, one in words that are nowhere.
FORMS = ("What is the {a} {b}?", "Compare {a} and {b}", "Why does {a} meet {b}?", "Where is {a}?", "Is {a} near {b}?", "How do {a} perform?", "Who saw {a} and {b}?", "What is {a}?", "Which zz{b}qx?")
ANYWHERE, ELSEWHERE = 6, 7


def asked_of_turns(spark, d) -> DataFrame:
    """(query_id, query, label)."""
    w = F.filter(T.tokens(F.col("text")), lambda x: F.length(x) > 4)
    c = read(spark, d, "conversations").where("role = 'user'").withColumn("w", w).where(F.size("w") > 0).select("conv_id", "turn", F.get("w", F.lit(0)).alias("a"), F.get("w", F.size("w") - 1).alias("b")).where("a <> b")
    form = (F.col("conv_id") * 7 + F.col("turn")) % len(FORMS)
    text = F.element_at(F.array(*[F.lit(x) for x in FORMS]), (form + 1).cast("int"))
    label = F.when(form == ELSEWHERE, F.col("conv_id") + 1_000_000).when(form != ANYWHERE, F.col("conv_id"))
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.replace(F.replace(text, F.lit("{a}"), F.col("a")), F.lit("{b}"), F.col("b")).alias("query"), label.alias("label"))


def grounded(spark, d, **limits) -> answering.Grounded:
    models = answering.Models(embedding.hash_embedder(), stand_ins.scripted_writer(), stand_ins.lexical_judge(), stand_ins.overlap_reranker())
    index = materialise(indexed(spark, d))
    return answering.answer(asked_of_turns(spark, d), index, models, answering.Limits(**limits))


ROOM = 2048 - evidence.OVERHEAD
STOPS = _list(T.GROUNDING_STOPS)
_OVERLAP = "len(list_intersect({a}, {b}))"
#: What the scripted writer says: the best n sentences.
SAID = """{n} AS (SELECT query_id, string_agg(s, ' ' ORDER BY pos) AS said FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o DESC, pos) AS r FROM so WHERE o > 0) WHERE r <= {most} GROUP BY query_id)"""
SCRIPT = "CASE form WHEN 3 THEN 'p1' WHEN 2 THEN said || ' It is so said by all.' WHEN 4 THEN 'It is not so that ' || said ELSE said END"
SHARE = "CASE WHEN len({t}) = 0 THEN 0.0 ELSE round(len(list_intersect({t}, {e})) / len({t}), 6) END"
DENIES = "list_has_any({c}, ['not', 'no', 'never', 'none', 'nor', 'neither', 'cannot', 'without'])"
ANSWERS = rf"""{CHUNKS}, {EMBEDDED.format(e='ce', t='ch')},
tw AS (SELECT conv_id, turn, list_filter({TOKENS.format(c='text')}, lambda x: length(x) > 4) AS w FROM conversations WHERE role = 'user'),
ab AS (SELECT conv_id, turn, w[1] AS a, w[-1] AS b, (conv_id * 7 + turn) % {len(FORMS)} AS form FROM tw WHERE len(w) > 0 AND w[1] <> w[-1]),
q AS (SELECT conv_id * 100 + turn AS query_id, form, a, b, replace(replace(x, '{{a}}', a), '{{b}}', b) AS question, CASE WHEN form = {ELSEWHERE} THEN conv_id + 1000000 WHEN form <> {ANYWHERE} THEN conv_id END AS label FROM ab JOIN (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(FORMS))}) v(i, x) ON i = form),
sub AS (SELECT query_id, label, 0 AS position, CASE form WHEN 1 THEN a ELSE regexp_replace(question, '[?.!]+$', '') END AS text FROM q WHERE form <> 5 UNION ALL SELECT query_id, label, 1, b FROM q WHERE form = 1),
st AS (SELECT query_id * 4 + position AS id, text FROM sub), {EMBEDDED.format(e='se', t='st')},
pool AS (SELECT sub.query_id, position, ch.id AS vec_id, {NEAR.format(a='se.v', b='ce.v')} AS score FROM sub JOIN se ON se.id = sub.query_id * 4 + sub.position JOIN ch ON sub.label IS NULL OR ch.conv_id = sub.label JOIN ce ON ce.id = ch.id),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, position ORDER BY score DESC, vec_id) AS r FROM pool) WHERE r <= 20),
mg AS (SELECT query_id, vec_id, max(score) AS score, min(position) AS first_seen FROM cut GROUP BY ALL),
mr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_seen, vec_id) AS original FROM mg),
rr AS (SELECT mr.query_id, vec_id, score, original, {SHARE.format(t=CONTENT.format(c='question'), e=CONTENT.format(c='text'))} AS new_score, conv_id, turn + 1 AS page, text FROM mr JOIN q USING (query_id) JOIN ch ON ch.id = vec_id),
ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY new_score DESC, score DESC, original) AS rank FROM rr) WHERE rank <= 5),
near AS (SELECT query_id, count(*) AS n_evidence, max(score) AS sim FROM ev GROUP BY query_id),
bl AS (SELECT *, '[Page ' || page || '] ' || text AS block FROM ev), tk AS (SELECT *, greatest(1, CAST(floor(length(block) / 3.5) AS INTEGER)) AS tok FROM bl),
us AS (SELECT *, sum(CASE WHEN rank = 1 THEN least(tok, {ROOM}) ELSE tok + 1 END) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM tk),
pk AS (SELECT *, CASE WHEN rank = 1 AND tok > {ROOM} THEN substr(block, 1, CAST(floor({ROOM} * 3.5) AS INTEGER)) || '...' ELSE block END AS shown FROM us WHERE used <= {ROOM}),
cx AS (SELECT query_id, string_agg(shown, chr(10) || chr(10) ORDER BY rank) AS context FROM pk GROUP BY query_id),
sp AS (SELECT query_id, list_filter(list_transform(string_split(regexp_replace(replace(regexp_replace(context, '(^|\n)\[Page \d+\] ', '\1', 'g'), chr(10) || chr(10), chr(1)), '([.!?])[ \t
\x0B\f
]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM cx),
sn AS (SELECT query_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS s FROM sp),
so AS (SELECT query_id, pos, s, len(list_intersect({CONTENT.format(c='question')}, {CONTENT.format(c='s')})) AS o FROM sn JOIN q USING (query_id)),
{SAID.format(n='one', most=1)}, {SAID.format(n='three', most=3)},
able AS (SELECT q.*, coalesce(n_evidence, 0) AS n_evidence, coalesce(sim, 0) AS sim, form <> 5 AND coalesce(n_evidence, 0) > 0 AND NOT (coalesce(sim, 0) > 0 AND coalesce(sim, 0) < 0.2) AS able FROM q LEFT JOIN near USING (query_id)),
w1 AS (SELECT able.*, {SCRIPT} AS first_answer FROM able LEFT JOIN one USING (query_id)),
l1 AS (SELECT *, able AND form = 1 AND first_answer IS NOT NULL AND NOT (contains(lower(first_answer), a) AND contains(lower(first_answer), b)) AS again FROM w1),
w2 AS (SELECT l1.*, said AS second_answer FROM l1 LEFT JOIN three USING (query_id)),
an AS (SELECT *, CASE WHEN NOT able THEN NULL WHEN again THEN second_answer ELSE first_answer END AS answer, CASE WHEN NOT again THEN 'complete' WHEN contains(lower(second_answer), a) AND contains(lower(second_answer), b) THEN 'complete' ELSE 'incomplete_after_retry' END AS completeness FROM w2),
cl AS (SELECT query_id, question, generate_subscripts(parts, 1) AS pos, unnest(parts) AS claim FROM (SELECT query_id, question, list_transform(string_split(regexp_replace(answer, '([.!?])[ \t
\x0B\f
]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '[ \t
\x0B\f
]+', ' ', 'g'))) AS parts FROM an WHERE trim(coalesce(answer, '')) <> '')),
cf AS (SELECT *, {FORM.format(c='claim')} AS shape, CASE WHEN {FORM.format(c='claim')} <> 'declarative' THEN {stated('question', 'claim', FORM.format(c='claim'))} END AS said FROM cl WHERE length(claim) >= 3),
pr AS (SELECT cf.query_id, pos, claim, shape, nullif(said, claim) AS said, rank, vec_id, conv_id, text FROM cf JOIN pk USING (query_id)),
sc AS (SELECT *, {SHARE.format(t=CONTENT.format(c='claim'), e=CONTENT.format(c='text'))} AS e1, CASE WHEN said IS NOT NULL THEN {SHARE.format(t=CONTENT.format(c="coalesce(said, '')"), e=CONTENT.format(c='text'))} END AS e2,
  {DENIES.format(c=TOKENS.format(c='claim'))} <> {DENIES.format(c=TOKENS.format(c='text'))} AS d1, {DENIES.format(c=TOKENS.format(c="coalesce(said, '')"))} <> {DENIES.format(c=TOKENS.format(c='text'))} AS d2,
  regexp_replace(trim(lower(claim)), '[.!?]+$', '') AS bare, {TERMS.format(c='claim', n=2, stops=STOPS)} AS terms FROM pr),
hd AS (SELECT *, contains(lower(text), bare) OR (len({TERMS.format(c='bare', n=1, stops=STOPS)}) > 0 AND len(list_filter(list_distinct({TERMS.format(c='bare', n=1, stops=STOPS)}), lambda x: contains(lower(text), x))) / greatest(len(list_distinct({TERMS.format(c='bare', n=1, stops=STOPS)})), 1) >= 0.75) AS held,
  greatest(e1, coalesce(e2, e1)) AS best, least(CASE WHEN d1 THEN e1 ELSE 0.0 END, CASE WHEN e2 IS NULL THEN 9 WHEN d2 THEN e2 ELSE 0.0 END) AS con, len(terms) = 0 OR len(list_filter(terms, lambda x: contains(lower(text), x))) > 0 AS relevant FROM sc),
sm AS (SELECT *, CASE WHEN shape <> 'declarative' AND NOT held AND best >= 0.8 THEN 0.2 ELSE best END AS ent FROM hd),
cs AS (SELECT query_id, pos, max(ent) >= 0.8 AS e, coalesce(max(con) FILTER (relevant), 0) >= 0.8 AS c FROM sm GROUP BY query_id, pos),
rp AS (SELECT query_id, count(*) AS claims, count(*) FILTER (e AND NOT c) AS supported, count(*) FILTER (c AND NOT e) AS contradicted, count(*) FILTER (e AND c) AS conflicted FROM cs GROUP BY query_id),
rf AS (SELECT query_id, pos, e AND ent >= 0.8 AS supports, c AND relevant AND con >= 0.8 AS contradicts, conv_id, vec_id FROM sm JOIN cs USING (query_id, pos) WHERE (e AND ent >= 0.8) OR (c AND relevant AND con >= 0.8)),
iso AS (SELECT query_id, count(DISTINCT doc) <= 1 AND coalesce(bool_and(label IS NULL OR doc = label), true) AS isolated FROM (SELECT query_id, conv_id + CASE WHEN conv_id % 11 = 10 THEN 1 ELSE 0 END AS doc FROM rf) JOIN q USING (query_id) GROUP BY query_id),
oc AS (SELECT an.query_id, completeness, coalesce(again, false) AS regenerated, coalesce(claims, 0) AS claims, coalesce(supported, 0) AS supported, coalesce(contradicted, 0) AS contradicted, coalesce(conflicted, 0) AS conflicted, n_evidence, answer,
  CASE WHEN form = 5 THEN 'needs_clarification' WHEN n_evidence = 0 THEN 'no_evidence' WHEN sim > 0 AND sim < 0.2 THEN 'low_similarity' WHEN trim(coalesce(answer, '')) = '' THEN 'no_answer' WHEN coalesce(claims, 0) = 0 THEN 'no_claims' WHEN NOT coalesce(isolated, true) THEN 'isolation_error'
    WHEN supported < claims OR completeness = 'incomplete_after_retry' THEN 'refused' ELSE 'answered' END AS outcome FROM an LEFT JOIN rp USING (query_id) LEFT JOIN iso USING (query_id))"""


@query(f"""WITH {ANSWERS} SELECT query_id, outcome, CASE WHEN outcome = 'answered' THEN answer END AS answer, outcome = 'answered' AS answerable, completeness, regenerated, claims, supported, contradicted, conflicted, n_evidence,
  CASE WHEN outcome IN ('no_evidence', 'no_answer', 'no_claims') THEN 'empty' WHEN outcome NOT IN ('answered', 'refused') THEN 'unsupported' WHEN contradicted > 0 THEN 'contradicted' WHEN conflicted > 0 THEN 'conflicted' WHEN supported < claims THEN 'unsupported' ELSE 'grounded' END AS grounding_status FROM oc""")
def grounded_answers(spark, d):
    return grounded(spark, d).answers.drop("score", "unsupported")


@query(f"WITH {ANSWERS} SELECT outcome, count(*) AS n FROM oc GROUP BY outcome")
def grounded_outcomes(spark, d):
    return grounded(spark, d).answers.groupBy("outcome").agg(F.count("*").alias("n"))


BOARD = f"""WITH {STATUS}, {REFS}, f AS (SELECT answer_id, chunk_id, min((claim_index, CASE WHEN kind = 'supports' THEN 0 ELSE 1 END, position)) AS use FROM refs GROUP BY ALL),
n AS (SELECT answer_id, chunk_id, 'cite_' || row_number() OVER (PARTITION BY answer_id ORDER BY use, chunk_id) AS citation FROM f),
e AS (SELECT answer_id, evidence_rank AS chunk_id, max(entailment) AS best FROM pairs GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY best DESC, chunk_id) AS rank, row_number() OVER (PARTITION BY answer_id ORDER BY chunk_id) AS original_rank FROM e)
SELECT answer_id, chunk_id, CAST(rank AS INTEGER) AS rank, CAST(original_rank AS INTEGER) AS original_rank, coalesce(citation, '-') AS citation, citation IS NOT NULL AS used, original_rank > rank AS promoted FROM r LEFT JOIN n USING (answer_id, chunk_id)"""


def _board(spark, d, show: str) -> DataFrame:
    by = lambda *o: F.row_number().over(Window.partitionBy("answer_id").orderBy(*o))
    e = catalog._claim_pairs(spark, d).groupBy("answer_id", F.col("evidence_rank").alias("chunk_id")).agg(F.max("entailment").alias("best"))
    results = e.select("answer_id", "chunk_id", by(F.desc("best"), "chunk_id").alias("rank"), by("chunk_id").alias("original_rank"))
    return ranking.board(results, grounding.citations(catalog._refs(spark, d)), show=show).withColumn("citation", F.coalesce("citation", F.lit("-")))


@query(BOARD)
def evidence_board(spark, d):
    return _board(spark, d, "all")


@query(f"SELECT * FROM ({BOARD}) WHERE promoted")
def evidence_board_promoted(spark, d):
    return _board(spark, d, "promoted")


def reading_inputs(spark, d) -> tuple[DataFrame, DataFrame]:
    """Questions of the first turns of conversations, and all of their turns as evidence."""
    c = read(spark, d, "conversations")
    w = F.filter(T.tokens(F.col("text")), lambda x: F.length(x) > 4)
    q = c.where("turn % 2 = 0 and role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "conv_id", F.concat(F.lit("What of "), F.array_join(F.slice(w, 1, 3), " "), F.lit("?")).alias("query"))
    e = c.select("conv_id", F.col("turn").alias("rank"), F.concat_ws("_", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").alias("document_id"), (F.col("turn") + 1).alias("page_number"), "text").join(q.select("query_id", "conv_id"), "conv_id").drop("conv_id")
    return q.drop("conv_id"), e


@query()
def extractive_answers(spark, d):
    return qa.answer(*reading_inputs(spark, d), stand_ins.overlap_reader(stand_ins.READING), stand_ins.READING)


@query("SELECT doc_id AS id, text FROM documents WHERE doc_id = 3 UNION ALL SELECT conv_id * 100 + turn, text FROM conversations WHERE conv_id = 5 AND turn = 1 UNION ALL SELECT vec_id, CAST(label AS VARCHAR) FROM embeddings WHERE vec_id = 9")
def rows_by_id(spark, d):
    page = store.page_of_document(catalog.pages(spark, d), 5, 2).select((F.col("document_id") * 100 + F.col("page_number") - 1).alias("id"), "text")
    chunk = store.by_id(read(spark, d, "embeddings"), "vec_id", 9).select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("text"))
    return store.by_id(read(spark, d, "documents"), "doc_id", 3).select(F.col("doc_id").alias("id"), "text").unionByName(page).unionByName(chunk)
