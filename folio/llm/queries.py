"""The training-data operators as queries over the standard tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm import collocations, decontam, edit_embed, exact_dedup, html_cut, infill, langid, lm_score, mixing, quality, simhash, toxicity, url_tree


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, d: str) -> DataFrame:
    g = simhash.near_groups(_read(spark, d, "documents"))
    return g.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op2_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    return html_cut.extract(_read(spark, d, "pages"))


def op3_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontam.judged(_read(spark, d, "documents"), _read(spark, d, "benchmark")).drop("spans", "items")


def op4_lm_scoring(spark: SparkSession, d: str) -> DataFrame:
    return lm_score.score(_read(spark, d, "documents"))


def op5_language_id(spark: SparkSession, d: str) -> DataFrame:
    return langid.identify(_read(spark, d, "documents"))


def op6_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.taken(_read(spark, d, "documents")).drop("source")


def op7_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return edit_embed.grouped(_read(spark, d, "documents"))


def op8_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, d, "documents"), _read(spark, d, "labels"))


def op9_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.graded(_read(spark, d, "documents"), _read(spark, d, "labels"))


def op10_url_filters(spark: SparkSession, d: str) -> DataFrame:
    return url_tree.judge(_read(spark, d, "pages")).drop("template")


def op11_collocations(spark: SparkSession, d: str) -> DataFrame:
    return collocations.collocations(_read(spark, d, "documents"))


def op12_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.deduplicate(spark, f"{d}/documents.parquet")


def op13_infill(spark: SparkSession, d: str) -> DataFrame:
    return infill.digests(_read(spark, d, "documents"))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash, op2_html_extraction, op3_decontamination, op4_lm_scoring, op5_language_id, op6_mixing, op7_fingerprints, op8_toxicity, op9_quality, op10_url_filters, op11_collocations, op12_exact_dedup, op13_infill, pipeline)
    return {f.__name__: f for f in own}


#: op3 in SQL: words are turned into lists, and a document's windows of 13 words are met with the items' by equality.
OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (
  SELECT rid, i, s.n, array_to_string(w[i : i + s.n - 1], ' ') AS g
  FROM d, sizes s, unnest(range(1, greatest(len(w) - CAST(s.n AS BIGINT) + 2, 1))) AS t(i)),
hits AS (SELECT rid, i, grams.n, item FROM grams JOIN wins ON grams.n = wins.n AND grams.g = wins.g),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""


#: op11 in SQL: every phrase of every piece is written out and counted.
OP11_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, w FROM w WHERE len(w) > 0),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM words, (VALUES (1), (2), (3)) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 10),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, k, phrase, a, c, array_to_string(w[: c], ' ') AS head, array_to_string(w[c + 1 :], ' ') AS rest FROM cand, unnest(range(1, k)) AS t(c)),
s AS (SELECT cuts.lang, cuts.k, cuts.phrase, a, c, x.f AS l, y.f AS r, CAST((1000000 * CAST(a AS HUGEINT) * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.head JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.rest),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS o FROM s),
longer AS (SELECT lang, sub, max(a) AS above FROM (SELECT lang, a, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS sub FROM cand WHERE k = 3) GROUP BY lang, sub),
kept AS (SELECT best.lang, phrase, a, l, r, score FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.sub = phrase AND k = 2 WHERE o = 1 AND NOT coalesce(100 * above >= 50 * a, false)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

OP12_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""

#: op13 in SQL: lines as a list, cut by slices. The text is rebuilt by splitting the output at the sentinels.
OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS w, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, len(w) AS n, CAST('0x' || x[1:8] AS BIGINT) % (len(w) + 1) AS c1, CAST('0x' || x[9:16] AS BIGINT) % (len(w) + 1) AS c2, CAST('0x' || x[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || x[25:32] AS BIGINT) % 100 AS h4 FROM d),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 100 THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(w[1 : least(c1, c2)], '') AS p, array_to_string(w[least(c1, c2) + 1 : greatest(c1, c2)], '') AS m, array_to_string(w[greatest(c1, c2) + 1 :], '') AS s FROM h),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM f),
r AS (SELECT *, regexp_split_to_array(output, '<[PSM]>') AS part FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN part[2] || part[4] || part[3] ELSE part[3] || part[4] || part[2] END) AS restored_sha256 FROM r
"""


def _op10_sql() -> str:
    """op10 in SQL: the trees' levels one after another."""
    rules = sorted(url_tree.RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for h, p, _ in rules]
    rule = "CASE " + " ".join(f"{w} '{h}{p}'" for w, (h, p, _) in zip(fits, rules, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"{w} '{v}'" for w, (*_, v) in zip(fits, rules, strict=True)) + " END"
    out = [rf"""
WITH raw AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
cut AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM raw),
parsed AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM cut),
p AS (SELECT *, {rule} AS rule, {verdict} AS given FROM parsed),
urls AS (SELECT host, path, count(*) AS n, count(given) AS seen, count(*) FILTER (given = 'block') AS blocked FROM p GROUP BY host, path),
t0 AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS seg, ['/'] AS nodes FROM urls)"""]
    for k in range(url_tree.LEVELS):
        out.append(f"""
u{k} AS (SELECT *, nodes[-1] AS node, CASE WHEN len(seg) > {k} THEN seg[{k + 1}] END AS child FROM t{k}),
c{k} AS (SELECT host, node, child, sum(n) AS visits FROM u{k} WHERE child IS NOT NULL GROUP BY host, node, child),
k{k} AS (SELECT host, node, child FROM (SELECT *, sum(visits) OVER (PARTITION BY host, node) AS total FROM c{k}) WHERE visits >= {url_tree.FEWEST} AND visits >= {url_tree.SHARE} * total),
t{k + 1} AS (SELECT u.host, u.path, u.n, u.seen, u.blocked, u.seg, CASE WHEN u.child IS NULL THEN nodes ELSE list_append(nodes, u.node || CASE WHEN k.child IS NULL THEN '*' ELSE k.child END || '/') END AS nodes
  FROM u{k} u LEFT JOIN k{k} k ON k.host = u.host AND k.node = u.node AND k.child = u.child)""")
    deep = url_tree.LEVELS
    out.append(f"""
tree AS (SELECT host, path, seen, blocked, CASE WHEN len(seg) > {deep} THEN list_append(nodes, nodes[-1] || '**') ELSE nodes END AS nodes FROM t{deep}),
flat AS (SELECT host, nodes, seen, blocked, unnest(range(len(nodes))) AS depth FROM tree),
stats AS (SELECT host, depth, nodes[depth + 1] AS node, CASE WHEN depth > 0 THEN nodes[depth] END AS parent, CAST(sum(seen) AS DOUBLE) AS seen, CAST(sum(blocked) AS DOUBLE) AS blocked FROM flat GROUP BY ALL),
r0 AS (SELECT host, node, (blocked + {url_tree.SMOOTH} * coalesce((SELECT sum(blocked) / sum(seen) FROM stats WHERE depth = 0 HAVING sum(seen) > 0), 0)) / (seen + {url_tree.SMOOTH}) AS rate FROM stats WHERE depth = 0)""")
    order = "PARTITION BY host, parent, seen > 0 ORDER BY blocked / greatest(seen, 1), node"
    for k in range(1, deep + 2):
        out.append(f"""
a{k} AS (SELECT *, lag(blocked) OVER ({order}) AS b0, lag(seen) OVER ({order}) AS s0 FROM stats WHERE depth = {k}),
b{k} AS (SELECT *, (blocked + b0) / (seen + s0) AS q, blocked / seen - b0 / s0 AS apart FROM a{k}),
d{k} AS (SELECT *, CASE WHEN seen > 0 AND s0 > 0 AND apart * apart >= {url_tree.Z} * {url_tree.Z} * greatest(q * (1 - q), {url_tree.FLAT}) * (1 / seen + 1 / s0) THEN 1 ELSE 0 END AS fresh FROM b{k}),
g{k} AS (SELECT *, sum(fresh) OVER ({order} ROWS UNBOUNDED PRECEDING) AS merged FROM d{k}),
h{k} AS (SELECT host, node, parent, sum(blocked) OVER w AS ab, sum(seen) OVER w AS sb FROM g{k} WINDOW w AS (PARTITION BY host, parent, seen > 0, merged)),
r{k} AS (SELECT h.host, h.node, (ab + {url_tree.SMOOTH} * r.rate) / (sb + {url_tree.SMOOTH}) AS rate FROM h{k} h JOIN r{k - 1} r ON r.host = h.host AND r.node = h.parent)""")
    out.append("\nrates AS (" + " UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(deep + 2)) + ")")
    return ",".join(out) + f"""
SELECT page_id, p.host, p.path, rule, coalesce(given, CASE WHEN rate >= {url_tree.REJECT} THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN tree ON tree.host = p.host AND tree.path = p.path JOIN rates ON rates.host = tree.host AND rates.node = tree.nodes[-1]"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3_SQL, "op10_url_filters": _op10_sql(), "op11_collocations": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_infill": OP13_SQL}
