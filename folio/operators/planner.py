"""Query plans as columns: normalising, classes, constraints, entities, aspects, sub-questions, retrieval queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T

# Fixed values: (class, answer type, patterns that must all be found in the lower-cased query, pattern that must not), in order.
_PARTS = r",\s*and\s+(how|what|why|which|where)\b|\band\s+how\s+does\b|[^?\s][^?]*\?[?\s]*[^?\s]"
RULES: tuple[tuple[str, str, tuple[str, ...], str | None], ...] = (
    ("ambiguous", "explanation", (r"\b(single\s+best|best.*for\s+all|worst.*for\s+all)\b|^how\s+do\s+\w+\s+perform\??$",), None),
    ("multi_hop", "explanation", (
        r"\b(mother|father|founder|inventor|author|creator|advisor|teacher)\s+of\s+the\s+(founder|inventor|author|creator)\b|\bwho\s+was\s+the\s+.*\s+of\s+the\s+(founder|author|inventor)\b"
        r"|\bwhat\s+happened\s+in\s+the\s+year\s+that\b|\bwhich\s+company\s+acquired\s+the\s+firm\s+that\b",), None),
    ("multi_page", "explanation", (_PARTS, r"\brelate\s+to\b|\btrade-?offs?\b"), None),
    ("multi_part", "explanation", (_PARTS,), None),
    ("multi_page", "explanation", (r"\bpages?\s+\d+.*(?:and|to|-).*\d+\b",), None),
    ("multi_page", "explanation", (r"\brelate\s+to\b", r"\b(metrics?|evaluation|latency)\b"), None),
    ("comparison", "comparison", (r"\bcompare\b|\b(difference|differences)\s+between\b|\b(vs\.?|versus)\b|\bhow\s+does\s+.*\s+(differ\s+from|compare\s+to)\b",), None),
    ("numerical_fact", "number", (r"\b(exact\s+derivative|derivative\s+of|derivative|formula\s+for|formula\s+to)\b|\bwhat\s+is\s+the\s+(formula|exact\s+value|value|ratio|percentage|fraction)\b",), None),
    ("summary", "summary", (r"^summarize\b|\b(summary|overview|synopsis)\s+(of|for)\b|^give\s+a\s+summary\b",), None),
    ("procedural", "procedure", (
        r"^how\s+(do|can|does|to|would)\s+(you|one|we)?\s*(perform|implement|calculate|compute|train|build|create|derive|evaluate|run|execute|use)\b|^how\s+to\s+|\b(steps?|procedure|algorithm|process)\s+(to|for|of)\b",), None),
    ("causal", "explanation", (r"^why\b|\b(causes?|reasons?)\s+(of|for|behind)\b|^what\s+(caused|causes)\b|^how\s+did\s+.*\s+(cause|lead\s+to|result\s+in)\b",), None),
    ("list", "list", (r"^list\b|\b(name|list)\s+(the|all|some)\b|^what\s+are\s+(the\s+)?(main|primary|key|different|various|major)\s+(types|components|methods|examples|features|elements|approaches|factors)\b",), None),
    ("definition", "definition", (r"^what\s+(is|are|was|were)\s+(a|an|the)?\s*[\w\s+\-*]+(?:\?|\.|$)",), r"\b(causes?|reasons?|difference|steps?|procedure|chapter|page|role)\b"),
    ("definition", "definition", (r"^define\b|^what\s+does\s+.*\s+mean\b",), None),
    ("location", "location", (r"^where\b|\bwhich\s+(chapter|page|section)\b",), None),
    ("explanation", "explanation", (r"^(why|how\s+does|how\s+do|how\s+did)\b",), None),
    ("factual", "person/entity", (r"^who\b",), None),
    ("factual", "date/year", (r"^when\b|\b(what|in\s+which)\s+year\b",), None),
    ("factual", "number", (r"^how\s+(many|much)\b",), None),
    ("factual", "explanation", (r"^(which|what|did|does|is|was|were|has|have)\b",), None),
)
_QUOTED = r"[\"']([^\"']{2,})[\"']"
_NAMES = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"
_YEAR = r"\b(1[89]\d\d|20\d\d)\b"
# The two sides of a comparison; the second pattern set also serves without dropping articles.
ASPECTS = (
    r"(?i)(?:difference|differences)\s+between\s+(.+?)\s+(?:and|vs\.?|versus)\s+(.+?)(?:\s+in\s+terms\s+of|\s+in\s+|\s+during\s+|\?|\.|$)",
    r"(?i)compare\s+(?:the\s+)?(?:[a-zA-Z\s]+\s+of\s+)?(.+?)\s+(?:and|vs\.?|versus)\s+(.+?)(?:\s+in\s+|\s+during\s+|\?|\.|$)",
    r"(?i)\b(.+?)\s+(?:vs\.?|versus)\s+(.+?)(?:\?|\.|$)",
)
_BOTH = r"(?i)(?:causes?\s+and\s+(?:consequences?|effects?|impacts?)|(?:consequences?|effects?|impacts?)\s+and\s+causes?)\s+(?:of\s+)?(.+?)(?:\?|\.|$)"


def _strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def _bare(s: Column) -> Column:
    """Without white space around and marks behind."""
    return F.regexp_replace(_strip(s), r"[?.!]+$", "")


def _has(s: Column, pattern: str) -> Column:
    return s.rlike("(?U)" + pattern)


def normalise(q: Column) -> Column:
    """Tabs, no-break spaces and runs of white space become single spaces; a blank query is null."""
    s = _strip(F.regexp_replace(F.translate(q, "\u00a0\t", "  "), "[ \f\u000b\r\n]+", " "))
    return F.when(s != "", s)


def classify(q: Column) -> Column:
    """struct(type, answer) of the first rule that fits; unknown without any."""
    low, out = F.lower(q), None
    for name, answer, needed, barred in RULES:
        fits = _has(low, needed[0])
        for pattern in needed[1:]:
            fits = fits & _has(low, pattern)
        if barred:
            fits = fits & ~_has(low, barred)
        value = F.struct(F.lit(name).alias("type"), F.lit(answer).alias("answer"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out.otherwise(F.struct(F.lit("unknown").alias("type"), F.lit("explanation").alias("answer")))


def _number(s: Column) -> Column:
    return s.try_cast("int")


def quoted(q: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(q, F.lit(_QUOTED), F.lit(1)), _strip), lambda x: x != "")


def constraints(q: Column) -> Column:
    """struct(chapter, page, page_from, page_to, year, quoted, named). Extracted; retrieval doesn't filter by them."""
    ranged = r"(?i)\bpages?\s+(\d+)\s*(?:-|to)\s*(\d+)\b"
    a, b = _number(F.regexp_extract(q, ranged, 1)), _number(F.regexp_extract(q, ranged, 2))
    rest = F.regexp_replace(q, r"(?i)^(Who|What|Where|When|Why|How|Which|Compare|Summarize|List|Define)\b", "")
    return F.struct(
        _number(F.regexp_extract(q, r"(?i)\b(?:chapter|ch\.?)\s+(\d+)\b", 1)).alias("chapter"), F.when(~q.rlike(ranged), _number(F.regexp_extract(q, r"(?i)\bpages?\s+(\d+)\b", 1))).alias("page"), F.least(a, b).alias("page_from"),
        F.greatest(a, b).alias("page_to"), _number(F.regexp_extract(q, _YEAR, 1)).alias("year"), quoted(q).alias("quoted"), F.array_distinct(F.regexp_extract_all(rest, F.lit(_NAMES), F.lit(1))).alias("named"),
    )


def entities(q: Column) -> Column:
    """Distinct, in order of kind: quoted phrases, technical tokens, capitalised words (not a stop word), capitalised names, years."""
    words = F.transform(F.split(q, r"(?U)\s+"), lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}_+\-*]", ""))
    named = F.filter(words, lambda x: x.rlike(r"^\p{Lu}") & ~F.lower(x).isin(*T.PLANNER_STOPS))
    technical = r"\b(C\+\+|COVID-19|R&D|A\*|[A-Z]{2,}(?:-[A-Z0-9]+)?)\b"
    all_of = lambda p: F.regexp_extract_all(q, F.lit(p), F.lit(1))
    return F.array_distinct(F.concat(quoted(q), all_of(technical), named, all_of(_NAMES), all_of(_YEAR)))


def _sides(s: Column, pattern: str, articles: bool) -> Column:
    """The two sides, if the pattern is found and they differ."""
    side = lambda k: _bare(F.regexp_extract(s, "(?U)" + pattern, k))
    a, b = ((_strip(F.regexp_replace(side(k), r"(?i)^(?:the|a|an)\s+", "")) if articles else side(k)) for k in (1, 2))
    return F.when(_has(s, pattern) & (a != "") & (b != "") & (F.lower(a) != F.lower(b)), F.array(a, b))


def aspects(q: Column) -> Column:
    """The two sides of a comparison, articles dropped, if they differ; else an empty array."""
    return F.coalesce(*[_sides(q, p, True) for p in ASPECTS], F.array().cast("array<string>"))


def sub_questions(q: Column) -> Column:
    """Up to three parts of a question of several: cut at a second question word, else at question marks; else none."""
    parts = F.split(q, r"(?iU),?\s*\band\s+(?:how|what|why|which|where)\b")
    by_word = F.filter(F.transform(parts, lambda p: _strip(F.regexp_replace(_bare(p), r"(?i)^(?:and|how|what|why|which|where)\s+", ""))), lambda p: F.length(p) > 3)
    by_mark = F.filter(F.transform(F.filter(F.split(q, r"\?"), lambda p: _strip(p) != ""), _bare), F.isnotnull)
    none = F.array().cast("array<string>")
    return F.when((F.size(parts) >= 2) & (F.size(by_word) >= 2), F.slice(by_word, 1, 3)).when(F.size(by_mark) >= 2, F.slice(by_mark, 1, 3)).otherwise(none)


def plan(queries: DataFrame, column: str = "query") -> DataFrame:
    """queries with the whole plan; blank queries are left out."""
    p = queries.withColumn("normalised", normalise(F.col(column))).where("normalised is not null")
    n, none = F.col("normalised"), F.array().cast("array<string>")
    p = p.withColumn("class", classify(n)).withColumn("constraints", constraints(n)).withColumn("entities", entities(n))
    kind = F.col("class.type")
    p = p.withColumn("aspects", F.when(kind == "comparison", aspects(n)).otherwise(none)).withColumn("parts", F.when(kind.isin("multi_part", "multi_page"), sub_questions(n)).otherwise(none))
    year = F.coalesce(F.concat(F.lit(" "), F.col("constraints.year").cast("string")), F.lit(""))
    again = r"(?i)(?:compare\s+(?:the\s+)?(?:[a-zA-Z\s]+\s+of\s+)?|difference\s+between\s+)(.+?)\s+(?:and|vs\.?|versus)\s+(.+?)(?:\s+in\s+|\s+during\s+|\?|\.|$)"
    target = _bare(F.regexp_extract(n, "(?U)" + _BOTH, 1))
    searches = (
        F.when(F.size("aspects") == 2, F.transform("aspects", lambda a: F.concat(a, year))).when((kind == "comparison") & _sides(n, again, False).isNotNull(), _sides(n, again, False))
        .when(F.size("parts") >= 2, F.slice("parts", 1, 2))
        .when(kind.isin("causal", "list", "factual") & (target != ""), F.array(F.concat(F.lit("causes of "), target), F.concat(F.lit("consequences of "), target))).otherwise(F.array(F.regexp_replace(n, r"[?.!]+$", "")))
    )
    found = F.slice(F.array_distinct(F.filter(F.transform(searches, _strip), lambda s: s != "")), 1, 3)
    p = p.withColumn("retrieval_queries", found).withColumn("retrieval_queries", F.when(F.size("retrieval_queries") > 0, F.col("retrieval_queries")).otherwise(F.array(n)))
    many = (F.size("retrieval_queries") > 1) | kind.isin("comparison", "list", "multi_hop", "summary", "multi_part", "multi_page")
    numeric = (kind == "numerical_fact") | _has(F.lower(n), r"\b(derivative|formula|value|rate|ratio|percentage|how\s+many|how\s+much)\b")
    return p.withColumn("multiple_evidence", many).withColumn("is_numerical", numeric)
