"""Files as sources, over raw web pages: uploads and their guards, parsed documents, benchmark datasets, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folio.operators import store
from folio.plans.registry import query, read
from folio.sources import files

#: Where pages are said to lie: in the allowed folder, in ways around it, and elsewhere.
PATHS = ("/data/in/{n}.html", "file:///data/in/sub/../{n}.html", "/data/in/../{n}.html", "/data/in/../../etc/{n}.html", "/data/inside/{n}.html", "/data/in//./a b+{n}.HTML", "/data/in/{n}.pdf", "s3a://bucket/data/in/{n}.html")
PLACED = "pl AS (SELECT page_id, i, replace(p, '{n}', CAST(page_id AS VARCHAR)) AS path, CASE WHEN page_id % 13 = 0 THEN '' WHEN page_id % 13 = 1 THEN 'x' || html ELSE html END AS html FROM pages, (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(PATHS)) + ") v(i, p))"


def placed(spark, d):
    p = read(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 13 == 0, "").when(F.col("page_id") % 13 == 1, F.concat(F.lit("x"), "html")).otherwise(F.col("html")).alias("html"), F.posexplode(F.array(*[F.lit(p) for p in PATHS])).alias("i", "p"))
    return p.select("page_id", "i", F.replace("p", F.lit("{n}"), F.col("page_id").cast("string")).alias("path"), F.col("html").cast("binary").alias("content"))


@query(f"""WITH {PLACED} SELECT page_id, i, CASE WHEN i IN (2, 3, 4) THEN 'outside_folder' WHEN i = 6 THEN 'wrong_name' WHEN html = '' THEN 'empty' WHEN strlen(html) > 3000 THEN 'too_large' WHEN NOT starts_with(html, '<!DOCTYPE') THEN 'wrong_type' ELSE '-' END AS problem,
  substr(sha256(html), 1, 12) || '_' || regexp_replace(regexp_extract(path, '([^/]*)$', 1), '[^A-Za-z0-9._-]', '_', 'g') AS name, 'doc_' || substr(sha256(html), 1, 16) AS document_id FROM pl""")
def upload_guards(spark, d):
    u = files.uploads(placed(spark, d), ("/data/in",), ".html", b"<!DOCTYPE", 3000)
    return u.select("page_id", "i", F.coalesce("problem", F.lit("-")).alias("problem"), "name", "document_id")


_title = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&'), '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g'))"


@query(f"""SELECT page_id AS document_id, CASE WHEN page_id % 7 = 0 THEN 'unreadable' WHEN page_id % 7 = 1 THEN 'too_many_pages' ELSE '-' END AS problem, CASE WHEN page_id % 7 = 0 THEN '-' ELSE coalesce(nullif({_title}, ''), '-') END AS title,
  CAST(CASE WHEN page_id % 7 IN (0, 1) THEN 0 WHEN page_id % 7 = 2 THEN 3 ELSE 1 END AS BIGINT) AS pages FROM pages""")
def html_documents(spark, d):
    """Web pages as documents: some cut into pages by rules, some too long, some without markup."""
    n = F.col("page_id") % 7
    broken = F.regexp_replace("html", "<", " ")
    content = F.when(n == 0, broken).when(n == 1, F.concat("html", F.repeat(F.lit("<hr>"), 600))).when(n == 2, F.concat("html", F.lit("<hr>two<hr>three"))).otherwise(F.col("html"))
    f = read(spark, d, "pages").select(F.col("page_id").alias("document_id"), content.cast("binary").alias("content"), F.lit(None).cast("string").alias("problem"))
    p = files.parse_documents(f, files.html_document)
    g = p.groupBy("document_id").agg(F.max("problem").alias("problem"), F.max("metadata.title").alias("title"), F.count("page_number").alias("pages"))
    return g.select("document_id", F.coalesce("problem", F.lit("-")).alias("problem"), F.coalesce("title", F.lit("-")).alias("title"), "pages")


@query("""WITH i AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'x' WHEN item_id % 3 = 1 THEN 'y' ELSE 'uncategorised' END AS category, item_id % 4 <> 0 AS answerable, item_id % 5 = 0 AS verified, item_id % 7 = 0 AS unnamed, item_id % 8 = 0 AS chunked FROM benchmark)
SELECT coalesce(category, '*') AS category, count(*) AS items, count(*) FILTER (answerable) AS answerable, count(*) FILTER (NOT answerable) AS unanswerable, count(*) FILTER (verified) AS verified, count(*) FILTER (NOT verified) AS unverified,
  count(*) FILTER (unnamed OR (NOT answerable AND chunked)) AS problems FROM i GROUP BY GROUPING SETS ((), (category))""")
def dataset_summaries(spark, d):
    """A benchmark's items written as dataset files of some hundred items, under old and new keys, loaded and summed up."""
    n = F.col("item_id")
    own = lambda even, key: F.when((n % 2 == 0) == even, key)
    item = F.struct(
        own(True, F.when(n % 7 != 0, n.cast("string"))).alias("id"), own(False, F.when(n % 7 != 0, n.cast("string"))).alias("question_id"), own(True, F.col("text")).alias("question"), own(False, F.col("text")).alias("query"), F.lit("d").alias("document_id"), F.array(F.lit(1)).alias("relevant_pages"),
        F.when(n % 8 == 0, F.array(F.lit("c1"))).alias("relevant_chunk_ids"), (n % 4 != 0).alias("answerable"), F.when(n % 3 == 0, "x").when(n % 3 == 1, "y").alias("category"), F.when(n % 5 == 0, "verified").alias("verification_status"),
    )
    path = f"{store.scratch(spark)}/dataset-{uuid.uuid4().hex}"
    parts = read(spark, d, "benchmark").select(item.alias("i"), F.floor(n / 100).alias("part")).groupBy("part").agg(F.collect_list("i").alias("items"))
    parts.select("items", F.lit("b").alias("dataset_name"), F.lit("1").alias("version")).write.option("maxRecordsPerFile", 1).json(path)
    return files.dataset_summary(files.load_dataset(spark, path)).withColumn("category", F.coalesce("category", F.lit("*")))
