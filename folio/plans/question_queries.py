"""Question generation as queries: checks with SQL, the pipeline with its ledger.

The rows that are checked are made of benchmark items' words, one of each VARIANTS: a question, the expected answer, a reader's answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import candidates, question_checks, question_pipeline, sections
from folio.plans import stand_ins
from folio.plans.catalog import TOKENS, chunk_documents, pages
from folio.plans.registry import query, read

SOURCE = "{text} The definition of {c} is a long {c} tale of old. In 1998 the {a} and the {b} met {d}. It went on."
#: (question, answer, what the reader answers, trigger)
VARIANTS = (
    ("What met {d} in 1998?", "{a} and the {b}", "the {a} and the {b}", ""), ("", "{a}", "{a}", ""), ("Who?", "{a}", "{a}", ""), ("Who saw {a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}{a}?", "{a}", "{a}", ""),
    ("Who met {d} there", "{a}", "{a}", ""), ("-Who met {d} there?", "{a}", "{a}", ""), ("who met {d} there?", "{a}", "{a}", ""), ("Who met {d}? Who else?", "{a}", "{a}", ""), ("Who met, . {d} then?", "{a}", "{a}", ""), ("The {a} met {d}?", "the {a} met {d}", "{a}", ""),
    ("What is {a} {b}?", "{a} {b}", "{a}", ""), ("What is this about {a}?", "{a}", "{a}", ""), ("What did they see of {a}?", "{a}", "{a}", ""), ("What is it that Rome saw in {a}?", "{a}", "{a}", ""), ("What was the role of?", "{a}", "{a}", ""), ("What happened?", "{a}", "{a}", ""),
    ("How did {a} meet {d}?", "{a}", "{a}", "in order to"), ("Who met {d} at last?", "zzqx", "zzqx", ""), ("Who met Zanzibarq with {d}?", "{a}", "{a}", ""), ("Who met {d} then?", "{a}", "", ""), ("Who met {d} then?", "{a}", "{b} {d}", ""), ("When was {d} met?", "1998", "1999", ""), ("When was {d} met?", "1998", "In 1998", ""),
    ("When was {d} met?", "In 1998 the {a}", "1998", ""), ("Who met {d} then?", "{a}", "{a} and the {b} met", ""), ("What is the definition of {c}?", "{c}", "a long {c} tale of old", ""), ("What of {c} then?", "{c}", "a long {c} tale of old", ""),
    ("Who met {d} in the end?", "the {a} and the {b} met {d}", "{a} {b} met", ""), ("Who are met there in {d}?", "the {a} and the {b} met {d}", "{a} and {b} met", ""), ("Who went with {a}?", "The", "of the", ""), ("Why did the {a} meet {d}?", "{d}", "{D}!", ""),
)
_fill = lambda t: "replace(replace(replace(replace(replace({0}, '{{a}}', a), '{{b}}', b), '{{c}}', c), '{{d}}', d), '{{D}}', upper(d))".format(t)
_quote = lambda s: "'" + s.replace("'", "''") + "'"
ROWS = f"""bw AS (SELECT item_id, text, list_filter({TOKENS.format(c='text')}, lambda x: length(x) > 2) AS w FROM benchmark), wd AS (SELECT item_id, text, w[1] AS a, w[2] AS b, w[3] AS c, w[-1] AS d FROM bw WHERE len(w) > 3),
rw AS (SELECT item_id * 100 + i AS id, {_fill('vq')} AS question, {_fill('va')} AS answer, {_fill('vp')} AS predicted, vt AS trigger, replace({_fill(_quote(SOURCE))}, '{{text}}', text) AS source
  FROM wd, (VALUES {", ".join(f"({i}, {', '.join(map(_quote, v))})" for i, v in enumerate(VARIANTS))}) v(i, vq, va, vp, vt))"""


def rows(spark, d) -> DataFrame:
    """(id, question, answer, predicted, trigger, source)."""
    b = read(spark, d, "benchmark").withColumn("w", F.filter(T.tokens(F.col("text")), lambda x: F.length(x) > 2)).where(F.size("w") > 3)
    b = b.select("item_id", "text", F.posexplode(F.array(*[F.array(*[F.lit(x) for x in v]) for v in VARIANTS])).alias("i", "v"), *[F.get("w", at).alias(n) for n, at in (("a", F.lit(0)), ("b", F.lit(1)), ("c", F.lit(2)), ("d", F.size("w") - 1))])

    def fill(t):
        for n in "abcd":
            t = F.replace(t, F.lit(f"{{{n}}}"), F.col(n))
        return F.replace(t, F.lit("{D}"), F.upper("d"))

    v = lambda k: fill(F.get("v", F.lit(k)))
    return b.select((F.col("item_id") * 100 + F.col("i")).alias("id"), v(0).alias("question"), v(1).alias("answer"), v(2).alias("predicted"), v(3).alias("trigger"), F.replace(fill(F.lit(SOURCE)), F.lit("{text}"), F.col("text")).alias("source"))


NORM = r"trim(regexp_replace(regexp_replace(lower(trim({c})), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
LESS = "['a', 'an', 'the', 'and', 'or', 'but', 'if', 'as', 'because', 'while', 'when', 'where', 'why', 'how', 'all', 'any', 'both', 'each', 'few', 'more', 'most', 'other', 'some', 'such', 'no', 'nor', 'not', 'only', 'own', 'same', 'so', 'than', 'too', 'very', 'can', 'will', 'just', 'should', 'now', 'it', 'its', 'they', 'them', 'their', 'we', 'us', 'our', 'he', 'him', 'his', 'she', 'her', 'hers', 'i', 'me', 'my', 'you', 'your', 'yours', 'was', 'were', 'been', 'being', 'have', 'has', 'had', 'having', 'do', 'does', 'did', 'doing', 'would', 'could', 'of', 'to', 'in', 'out', 'on', 'off', 'from', 'for', 'with', 'at', 'by', 'is', 'are']"
_num = lambda c: rf"list_sort(list_distinct(regexp_extract_all({c}, '\b(\d+(?:\.\d+)?)\b', 1)))"
_run = lambda part, whole: f"(len({part}) = 0 OR len(list_filter(range(1, len({whole}) - len({part}) + 2), lambda i: {whole}[i : i + len({part}) - 1] = {part})) > 0)"
MATCH = rf"""{ROWS}, nm AS (SELECT *, {NORM.format(c='predicted')} AS p, {NORM.format(c='answer')} AS e, {NORM.format(c='question')} AS q, {_num('predicted')} AS np, {_num('answer')} AS ne, list_transform(string_split(regexp_replace(source, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {NORM.format(c='s')}) AS said FROM rw),
wl AS (SELECT *, list_filter(string_split(p, ' '), lambda x: x <> '' AND NOT list_contains({LESS}, x)) AS pw, list_filter(string_split(e, ' '), lambda x: x <> '' AND NOT list_contains({LESS}, x)) AS ew FROM nm),
ex AS (SELECT *, regexp_matches(question, '(?i)\b(definition|define|meaning)\b') AND len(ew) = 1 AND list_contains(string_split(p, ' '), ew[1]) AND len(list_filter(said, lambda s: contains(s, p) AND (contains(' ' || s || ' ', ' definition of ' || ew[1] || ' is ') OR contains(' ' || s || ' ', ' ' || ew[1] || ' is defined as ') OR contains(' ' || s || ' ', ' ' || ew[1] || ' refers to ')))) > 0 AS expands,
  len(pw) >= 3 AND len(ew) > len(pw) AND np = ne AND {_run('pw', 'ew')} AND len(list_intersect(list_distinct(list_filter(ew, lambda x: NOT list_contains(pw, x))), string_split(q, ' '))) / greatest(1, len(list_distinct(list_filter(ew, lambda x: NOT list_contains(pw, x))))) >= 0.5 AS clause FROM wl),
mt AS (SELECT *, p <> '' AND e <> '' AND (expands OR clause OR p = e OR (np = ne AND NOT (len(ew) = 1 AND len(pw) >= 3 AND list_contains(pw, ew[1]) AND NOT (len(ne) > 0 AND len(np) > 0)) AND len(ew) <= len(pw) AND {_run('ew', 'pw')})) AS matches FROM ex)"""


@query(f"WITH {MATCH} SELECT id, matches, CASE WHEN expands THEN 'definition_expansion' WHEN clause THEN 'clause' ELSE 'content_words' END AS how FROM mt")
def answer_match(spark, d):
    r, c = rows(spark, d), [F.col(x) for x in ("predicted", "answer", "question", "source")]
    how = F.when(question_checks.definition_expansion(*c), "definition_expansion").when(question_checks.clause_match(*c[:3]), "clause").otherwise("content_words")
    return r.select("id", question_checks.answer_matches(*c).alias("matches"), how.alias("how"))


QUALITY = r"""CASE WHEN trim(question) = '' THEN 'empty' WHEN length(trim(question)) < 8 THEN 'too_short' WHEN length(trim(question)) > 250 THEN 'too_long' WHEN NOT ends_with(trim(question), '?') THEN 'no_question_mark' WHEN regexp_matches(question, '^\s*[?!.,;:/_-]') THEN 'leading_punctuation'
  WHEN regexp_matches(question, '^\s*\p{L}') AND NOT regexp_matches(question, '^\s*\p{Lu}') THEN 'small_first_letter' WHEN length(question) - length(replace(question, '?', '')) > 1 THEN 'several_questions' WHEN regexp_matches(question, '[?!.,]\s*[?!.,]') THEN 'repeated_punctuation'
  WHEN lower(trim(regexp_replace(trim(question), '\?$', ''))) = lower(trim(source)) OR lower(trim(question)) = lower(trim(source)) THEN 'same_as_source' WHEN q = e THEN 'same_as_answer' WHEN q IN ('who is ' || e, 'what is ' || e, 'where is ' || e) THEN 'tautology'
  WHEN regexp_matches(q, '^(what is this|what is that|what is it|what is this about|what does this mean|what is the meaning of this|what does this chapter discuss|what is the book about|what is learning|how do computers learn|what is this book about|what are these)') THEN 'generic'
  WHEN regexp_matches(question, '(?i)\b(this|that|these|those|it|they|them|such|the above|the following|the former|the latter)\b') AND NOT regexp_matches(question, '\b(what|which|who|when|where|why|how)\s+(is|are|was|were|did|does|do|can|could|would|should)\s+[^?]*\b([A-Z][a-z]+|\d)\b') THEN 'ambiguous_reference'
  WHEN regexp_matches(question, '(?i)\b(role of|impact of|effect of|because of|because|and|or|but|that|with|from|by|about|in|at|to|which|for|as)\s*\?$') THEN 'dangling' WHEN q IN ('what is this', 'what is that', 'what is it', 'what happened', 'what did they do', 'why is that', 'who did this', 'what are these', 'how did this happen', 'what does it do') THEN 'vague' END"""
STARTS = "'What', 'Which', 'Where', 'When', 'Who', 'Whom', 'Why', 'How', 'Name', 'State', 'Define', 'Explain', 'Compare', 'Describe', 'Identify', 'Give', 'List', 'Does', 'According', 'In', 'Based', 'From'"
JUDGED = rf"""{MATCH}, ql AS (SELECT *, {QUALITY} AS poor FROM mt),
jd AS (SELECT *, CASE WHEN poor IS NOT NULL THEN poor WHEN trigger = 'in order to' AND regexp_matches(q, '^(how |by what method |what method |which method )') THEN 'purpose_clause' WHEN NOT contains(lower(source), lower(trim(answer))) THEN 'ungrounded'
  WHEN len(list_filter(regexp_extract_all(question, '\b([A-Z][a-z]{{2,}})\b', 1), lambda x: x NOT IN ({STARTS}) AND NOT contains(lower(source), lower(x)))) > 0 THEN 'outside_name' WHEN trim(predicted) = '' THEN 'unanswerable' WHEN NOT matches THEN 'answer_mismatch' END AS reason FROM ql)"""


@query(f"""WITH {JUDGED} SELECT id, coalesce(reason, '-') AS reason, CASE WHEN reason IS NULL THEN 'accepted' WHEN reason IN ('empty', 'too_short', 'leading_punctuation', 'repeated_punctuation', 'same_as_source', 'same_as_answer', 'tautology', 'dangling', 'vague') THEN 'quality_failure'
  WHEN reason IN ('unanswerable', 'answer_mismatch') THEN reason WHEN reason = 'ungrounded' THEN 'grounding_failure' WHEN reason = 'outside_name' THEN 'outside_knowledge' ELSE 'validation_failure' END AS category FROM jd""")
def question_outcomes(spark, d):
    return question_checks.judged(rows(spark, d)).select("id", F.coalesce("reason", F.lit("-")).alias("reason"), "category")


@query(f"WITH {JUDGED} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM jd GROUP BY reason")
def question_rejections(spark, d):
    return question_checks.judged(rows(spark, d)).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


#: Questions of every type, and the types of candidates that they may come from.
ASKED = (
    "Compare {a} and {b}", "What is the difference between {a} and {b}?", "What is the definition of {a}?", "What is meant by {a}?", "How many {a} are there?", "How much of {a}?", "What percentage of {a}?", "How high is {a}?", "Explain {a}", "What causes {a}?", "Why is {a} so?", "What is the result of {a}?",
    "Who saw {a}?", "Where is {a}?", "When was {a}?", "In what year was {a}?", "How does {a} work?", "What is {a}?", "Name {a}", "Which {a} is it?",
)
HINTS = ("", "direct_fact", "factual", "definition", "explanation", "comparison", "numerical", "numerical_fact", "reasoning", "multi_page_synthesis", "when", "who")
TYPED = rf"""{ROWS}, tq AS (SELECT item_id * 1000 + i * 20 + j AS id, replace(replace(t, '{{a}}', a), '{{b}}', b) AS question, nullif(h, '') AS hint, (item_id + i) % 10 = 0 AS several, lower(replace(replace(t, '{{a}}', a), '{{b}}', b)) AS q, repeat(a || ' ', 1 + i % 8) AS answer, repeat(text, 1 + j % 9) AS source
  FROM wd, (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(ASKED))}) x(i, t), (VALUES {", ".join(f"({j}, '{h}')" for j, h in enumerate(HINTS))}) y(j, h)),
ty AS (SELECT *, CASE WHEN several OR hint = 'multi_page_synthesis' THEN 'multi_page_synthesis' WHEN regexp_matches(q, 'compare|difference between|versus|in contrast|distinguish between') OR hint = 'comparison' THEN 'comparison'
  WHEN regexp_matches(q, 'definition of|what is meant by|define|defined as|what is the concept of') OR hint = 'definition' THEN 'definition'
  WHEN regexp_matches(q, '^how many|^how much|what percentage|how high|what rate') OR hint IN ('numerical', 'numerical_fact') THEN CASE WHEN q LIKE 'how many%' AND hint IS NULL THEN 'how_many' ELSE 'numerical_fact' END
  WHEN regexp_matches(q, 'explain|what causes|what is the mechanism') THEN 'explanation' WHEN q LIKE 'why%' THEN CASE WHEN hint = 'explanation' THEN 'explanation' ELSE 'why' END
  WHEN regexp_matches(q, 'reason|result of|consequence of|impact of|what follows from') OR hint = 'reasoning' THEN 'reasoning' WHEN q LIKE 'who%' THEN 'who' WHEN q LIKE 'where%' THEN 'where' WHEN q LIKE 'when%' OR regexp_matches(q, 'what year|what date') THEN 'when' WHEN q LIKE 'how%' THEN 'how'
  WHEN q LIKE 'what%' THEN CASE WHEN hint = 'direct_fact' THEN 'direct_fact' ELSE 'what' END WHEN hint IN ('direct_fact', 'factual') THEN hint ELSE 'factual' END AS type FROM tq)"""


@query(f"""WITH {TYPED} SELECT id, type, CASE WHEN type IN ('multi_page_synthesis', 'reasoning', 'comparison', 'explanation', 'why', 'how') THEN 'hard'
  WHEN type IN ('who', 'when', 'where', 'how_many', 'numerical', 'numerical_fact', 'direct_fact') THEN CASE WHEN len(string_split(trim(answer), ' ')) <= 4 AND length(source) < 700 THEN 'easy' ELSE 'medium' END WHEN len(string_split(trim(answer), ' ')) > 6 OR length(source) > 800 THEN 'medium' ELSE 'easy' END AS difficulty FROM ty""")
def question_types(spark, d):
    b = read(spark, d, "benchmark").withColumn("w", F.filter(T.tokens(F.col("text")), lambda x: F.length(x) > 2)).where(F.size("w") > 3).withColumns({"a": F.get("w", F.lit(0)), "b": F.get("w", F.lit(1))})
    q = b.select("item_id", "text", "a", "b", F.posexplode(F.array(*[F.lit(t) for t in ASKED])).alias("i", "t")).select("*", F.posexplode(F.array(*[F.lit(h) for h in HINTS])).alias("j", "h"))
    q = q.withColumns({"question": F.replace(F.replace("t", F.lit("{a}"), F.col("a")), F.lit("{b}"), F.col("b")), "hint": F.nullif("h", F.lit("")), "answer": F.repeat(F.concat("a", F.lit(" ")), 1 + F.col("i") % 8), "source": F.repeat("text", 1 + F.col("j") % 9)})
    q = q.withColumn("type", question_checks.question_type(F.col("question"), F.col("hint"), (F.col("item_id") + F.col("i")) % 10 == 0))
    return q.select((F.col("item_id") * 1000 + F.col("i") * 20 + F.col("j")).alias("id"), "type", question_checks.difficulty(F.col("type"), F.col("answer"), F.col("source")).alias("difficulty"))


ENDS = ("", "?", " ??", " . ", "!", " ? \n ?")


@query(rf"""WITH r AS (SELECT item_id * 10 + i AS id, CASE WHEN i = 6 THEN '  ' ELSE '  ' || replace(text, ' ', '  ') || e END AS s FROM benchmark, (VALUES {", ".join(f"({i}, {_quote(e)})" for i, e in enumerate((*ENDS, "")))}) v(i, e)),
t AS (SELECT id, trim(regexp_replace(s, '\s+', ' ', 'g')) AS t FROM r), u AS (SELECT id, regexp_replace(upper(substr(t, 1, 1)) || substr(t, 2), '[\s?]+$', '?') AS t FROM t) SELECT id, CASE WHEN t = '' OR ends_with(t, '?') THEN t ELSE t || '?' END AS question FROM u""")
def question_cleaning(spark, d):
    r = read(spark, d, "benchmark").select("item_id", "text", F.posexplode(F.array(*[F.lit(e) for e in (*ENDS, "")])).alias("i", "e"))
    s = F.when(F.col("i") == 6, F.lit("  ")).otherwise(F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("  ")), F.col("e")))
    return r.select((F.col("item_id") * 10 + F.col("i")).alias("id"), question_checks.question_clean(s).alias("question"))


@query("SELECT conv_id, page, next_page FROM (SELECT conv_id, turn // 2 AS page, lead(turn // 2) OVER (PARTITION BY conv_id ORDER BY turn) AS next_page FROM conversations) WHERE next_page <> page AND next_page - page <= 2")
def adjacent_multipage_pairs(spark, d):
    c = read(spark, d, "conversations").withColumn("page", F.floor(F.col("turn") / 2))
    return candidates.adjacent_pages(c, "conv_id", "page", "turn").select("conv_id", "page", "next_page")


def question_chunks(spark, d) -> DataFrame:
    """Chunks of all documents, and of conversations as documents of several pages whose later pages contrast with the earlier."""
    w = F.filter(T.tokens(F.col("text")), lambda x: F.length(x) > 4)
    against = F.concat(F.lit("In contrast, "), F.get(w, F.lit(0)), F.lit(" "), F.get(w, F.lit(1)), F.lit(" is Known To All. "))
    turns = pages(spark, d).select(F.concat(F.lit("c"), F.col("document_id").cast("string")).alias("document_id"), F.concat(F.lit("c"), F.col("document_id").cast("string"), F.lit("_"), F.col("page_number").cast("string")).alias("chunk_id"), "page_number", (F.col("page_number") - 1).cast("int").alias("chunk_index"), F.concat(F.when(F.size(w) > 1, against).otherwise(""), "text").alias("text"))
    docs = chunk_documents(spark, d).select(F.concat(F.lit("d"), F.col("document_id").cast("string")).alias("document_id"), "chunk_id", F.col("page_number").cast("int").alias("page_number"), F.col("chunk_index").cast("int").alias("chunk_index"), "text")
    return turns.unionByName(docs)


@query()
def question_ledger(spark, d):
    return question_pipeline.tallies(question_pipeline.generate(question_chunks(spark, d), stand_ins.cloze_asker(), stand_ins.cloze_reader())[1])


@query()
def generated_questions(spark, d):
    return question_pipeline.generate(question_chunks(spark, d), stand_ins.cloze_asker(), stand_ins.cloze_reader())[0].drop("source")


#: Turns with headings of front and back matter, so that what follows inherits them.
HEADED = ("PREFACE\nThis book", "", "", "CHAPTER 3 Of things", "REFERENCES\nSmith, J. A. (1999). pp. 12", "Smith, J. A. (1999). pp. 12 Jones, K. L. (2001). pp. 3", "", "ACKNOWLEDGMENTS: to all", "")


def headed_chunks(spark, d) -> DataFrame:
    head = F.element_at(F.array(*[F.lit(h) for h in HEADED]), ((F.col("conv_id") + F.col("turn")) % len(HEADED) + 1).cast("int"))
    return read(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.concat_ws("_", "conv_id", "turn").alias("chunk_id"), (F.col("turn") + 1).cast("int").alias("page_number"), F.col("turn").cast("int").alias("chunk_index"), F.concat(head, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


@query()
def section_labels(spark, d):
    return sections.classified(headed_chunks(spark, d)).select("document_id", "chunk_id", "category", "reason", "eligible")
