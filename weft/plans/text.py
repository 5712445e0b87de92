"""Registered text-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import text as X
from weft.functions.jsonio import parse_response as parse_reply
from weft.functions.jsonio import request_items
from weft.operators.ordering import global_index, positions_in_group
from weft.plans import sqlfrag as S
from weft.plans.audit import NORM_SQL
from weft.plans.fixtures import QA_ROWS_SQL, qa_rows
from weft.session import cut_lineage, table

QUERIES: dict = {}
ORACLE: dict = {}


def clean_text(spark, sf):
    """B1 on every document and conversation turn."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return d.unionByName(c).select("id", X.clean_text("text").alias("text"))


QUERIES["clean_text"] = clean_text
ORACLE["clean_text"] = f"""
SELECT doc_id AS id, {S.clean('text')} AS text FROM documents
UNION ALL SELECT conv_id * 1000 + turn, {S.clean('text')} FROM conversations
"""


def clean_text_list(spark, sf):
    """B2: a document's lines as a list -> strip, drop empty, join by newline."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.clean_text_list(F.split("text", "\n")).alias("text"))


QUERIES["clean_text_list"] = clean_text_list
ORACLE["clean_text_list"] = f"""
WITH j AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
             lambda x: {S.strip('x')}), lambda x: x <> ''), chr(10)) AS t FROM documents)
SELECT doc_id, {S.clean('t')} AS text FROM j
"""


def _posts(spark, sf):
    """Conversations as posts: title = turn 0, selftext = turn 1, body = all later
    turns in order, one a line (text and content absent)."""
    c = table(spark, sf, "conversations")
    later = F.array_sort(F.collect_list(F.when(F.col("turn") >= 2, F.struct("turn", "text"))))
    body = F.array_join(F.transform(later, lambda x: x["text"]), "\n")
    return c.groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("title"),
        F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("selftext"), body.alias("body"))


_POSTS_SQL = """posts AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS title,
                         max(CASE WHEN turn = 1 THEN text END) AS selftext,
                         string_agg(text, chr(10) ORDER BY turn, text) FILTER (WHERE turn >= 2) AS body
                  FROM conversations GROUP BY conv_id)"""


def merge_text_fields(spark, sf):
    """First-seen distinct non-empty cleaned fields joined by newline."""
    p = _posts(spark, sf)
    return p.select("conv_id", X.merge_text_fields(p.columns).alias("text"))


QUERIES["merge_text_fields"] = merge_text_fields
ORACLE["merge_text_fields"] = f"""
WITH {_POSTS_SQL},
l AS (SELECT conv_id, [{S.clean('title')}, {S.clean('selftext')}, {S.clean('body')}, '', ''] AS parts FROM posts)
SELECT conv_id, array_to_string(list_filter(parts, lambda x, i: x <> '' AND list_position(parts, x) = i), chr(10)) AS text
FROM l
"""


def normalize_query(spark, sf):
    """B8 (full): NFKC + casefold in a pandas UDF, then built-in regexes."""
    b = table(spark, sf, "benchmark")
    return b.select("item_id", X.normalize_query("text").alias("key"))


QUERIES["normalize_query"] = normalize_query
ORACLE["normalize_query"] = "SELECT item_id, " + NORM_SQL.replace("lower(query)", "lower(text)") + " AS key FROM benchmark"


def normalize_query_builtin(spark, sf):
    """B8 (JVM-only fold): lower instead of NFKC + casefold."""
    b = table(spark, sf, "benchmark")
    return b.select("item_id", X.normalize_query("text", unicode_fold=False).alias("key"))


QUERIES["normalize_query_builtin"] = normalize_query_builtin
ORACLE["normalize_query_builtin"] = "SELECT item_id, " + NORM_SQL.replace("replace(lower(query), 'ß', 'ss')", "lower(text)") + \
    " AS key FROM benchmark"

_SCRIPT_SQL = """CASE WHEN regexp_matches({t}, '[\\x{{0900}}-\\x{{097F}}]') AND regexp_matches({t}, '[A-Za-z]') THEN 'Devanagari + Latin'
     WHEN regexp_matches({t}, '[\\x{{0900}}-\\x{{097F}}]') THEN 'Devanagari only'
     WHEN regexp_matches({t}, '[A-Za-z]') THEN 'Latin only' ELSE 'Other' END"""


def script_class(spark, sf):
    """B9 per document and page."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    p = table(spark, sf, "pages").select((-F.col("page_id") - 1).alias("id"),
                                         F.col("html").alias("text"))
    return d.unionByName(p).select("id", X.script_class("text").alias("script"))


QUERIES["script_class"] = script_class
ORACLE["script_class"] = f"""
WITH u AS (SELECT doc_id AS id, text FROM documents
           UNION ALL SELECT -page_id - 1, html FROM pages)
SELECT id, {_SCRIPT_SQL.format(t='text')} AS script FROM u
"""


def contains_script(spark, sf):
    """Rows whose positive / any negative contains Devanagari or Latin."""
    qa = qa_rows(spark, sf)
    neg = ["negative1", "negative2", "negative3"]
    return qa.agg(
        F.count_if(X.contains_script("document")).alias("positive_devanagari"),
        F.sum(sum(X.contains_script(c).cast("int") for c in neg)).cast("bigint").alias("negative_devanagari"),
        F.count_if(X.contains_script("document", X.LATIN)).alias("positive_latin"),
        F.sum(sum(X.contains_script(c, X.LATIN).cast("int") for c in neg)).cast("bigint").alias("negative_latin"))


QUERIES["contains_script"] = contains_script
_DEV = "regexp_matches({c}, '[\\x{{0900}}-\\x{{097F}}]')"
_LAT = "regexp_matches({c}, '[A-Za-z]')"
ORACLE["contains_script"] = f"""
WITH {QA_ROWS_SQL}
SELECT CAST(count_if({_DEV.format(c='document')}) AS BIGINT) AS positive_devanagari,
       CAST(sum({' + '.join(_DEV.format(c=c) + '::INT' for c in ('negative1', 'negative2', 'negative3'))}) AS BIGINT) AS negative_devanagari,
       CAST(count_if({_LAT.format(c='document')}) AS BIGINT) AS positive_latin,
       CAST(sum({' + '.join(_LAT.format(c=c) + '::INT' for c in ('negative1', 'negative2', 'negative3'))}) AS BIGINT) AS negative_latin
FROM qa_rows
"""


def _post_rows(spark, sf):
    """Documents as forum posts: title = first line, selftext = the rest."""
    d = table(spark, sf, "documents")
    return d.select(
        F.concat(F.lit("t3_"), F.col("doc_id").cast("string")).alias("name"),
        F.col("source").alias("author"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.regexp_extract("text", r"^[^\n]*\n([\s\S]*)$", 1).alias("selftext"),
        F.col("n_chars").alias("ups"), F.lit(0).cast("bigint").alias("downs"),
        F.length("text").cast("bigint").alias("num_comments"),
        (F.col("doc_id") + 1_600_000_000).alias("created_utc"),
        (F.col("lang") == "de").alias("quarantine"))


def filter_posts(spark, sf):
    """Drop deleted/removed/quarantined posts and short title/body."""
    p = _post_rows(spark, sf)
    keep = ((F.col("title") != "[deleted by user]") & (F.col("selftext") != "[removed]")
            & (F.length("title") > 5) & (F.length("selftext") > 5)
            & (F.coalesce(F.col("quarantine"), F.lit(False)) == F.lit(False)))
    return p.filter(keep).select(F.col("name").alias("id"), "author", "title", "selftext", "ups",
                                 "downs", "num_comments", "created_utc")


QUERIES["filter_posts"] = filter_posts
ORACLE["filter_posts"] = """
WITH p AS (SELECT 't3_' || CAST(doc_id AS VARCHAR) AS name, source AS author, split_part(text, chr(10), 1) AS title,
                  coalesce(regexp_extract(text, '^[^\\n]*\\n([\\s\\S]*)$', 1), '') AS selftext, n_chars AS ups,
                  CAST(0 AS BIGINT) AS downs, CAST(length(text) AS BIGINT) AS num_comments,
                  doc_id + 1600000000 AS created_utc, lang = 'de' AS quarantine FROM documents)
SELECT name AS id, author, title, selftext, ups, downs, num_comments, created_utc FROM p
WHERE title <> '[deleted by user]' AND selftext <> '[removed]' AND length(title) > 5 AND length(selftext) > 5
  AND coalesce(quarantine, false) = false
"""


def project_comments(spark, sf):
    """Conversation turns as comments, renamed to the output schema."""
    c = table(spark, sf, "conversations")
    return c.selectExpr(
        "concat('t1_', conv_id, '_', turn) AS id", "concat('t3_', conv_id) AS post_id",
        "CASE WHEN turn = 0 THEN concat('t3_', conv_id) ELSE concat('t1_', conv_id, '_', turn - 1) END AS parent_id",
        "role AS author", "text AS body", "CAST(length(text) AS BIGINT) AS ups", "turn AS downs",
        "conv_id * 1000 + turn AS created_utc")


QUERIES["project_comments"] = project_comments
ORACLE["project_comments"] = """
SELECT 't1_' || conv_id || '_' || turn AS id, 't3_' || conv_id AS post_id,
       CASE WHEN turn = 0 THEN 't3_' || conv_id ELSE 't1_' || conv_id || '_' || (turn - 1) END AS parent_id,
       role AS author, text AS body, CAST(length(text) AS BIGINT) AS ups, turn AS downs,
       conv_id * 1000 + turn AS created_utc FROM conversations
"""


def _qa_pairs(spark, sf):
    """User turn -> the next assistant turn of the same conversation."""
    c = table(spark, sf, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("document"))
    return u.join(a, ["conv_id", "turn"])


_QA_PAIRS_SQL = """qp AS (SELECT u.conv_id, u.turn, u.text AS query, a.text AS document
       FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
       WHERE u.role = 'user' AND a.role = 'assistant')"""


def filter_non_empty_pair(spark, sf):
    """(query, document) pairs whose both sides are non-blank."""
    p = _qa_pairs(spark, sf)
    return (p.filter((X.clean_text("query", sentinels=()) != "") & (X.clean_text("document", sentinels=()) != ""))
            .select("conv_id", "turn"))


QUERIES["filter_non_empty_pair"] = filter_non_empty_pair
ORACLE["filter_non_empty_pair"] = f"""
WITH {_QA_PAIRS_SQL}
SELECT conv_id, turn FROM qp WHERE query IS NOT NULL AND document IS NOT NULL
  AND {S.strip('query')} <> '' AND {S.strip('document')} <> ''
"""


def filter_equals(spark, sf):
    """English documents with a good-quality label."""
    d = table(spark, sf, "documents").filter(F.col("lang") == "en")
    lab = table(spark, sf, "labels").filter(F.col("quality") == 1)
    return d.join(lab, "doc_id").select("doc_id", "source")


QUERIES["filter_equals"] = filter_equals
ORACLE["filter_equals"] = """
SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE lang = 'en' AND quality = 1
"""


def pad_negatives(spark, sf):
    """A document's non-empty lines as its hard negatives, exactly 3
    (repeat the last when short, cut when long)."""
    d = table(spark, sf, "documents")
    negs = F.filter(F.split("text", "\n"), lambda x: x != "")
    three = X.pad_list(negs, 3)
    return d.select("doc_id", *[F.sha2(three[i], 256).alias(f"negative_{i + 1}") for i in range(3)])


QUERIES["pad_negatives"] = pad_negatives
ORACLE["pad_negatives"] = """
WITH n AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS a FROM documents)
SELECT doc_id, sha256(a[least(1, len(a))]) AS negative_1, sha256(a[least(2, len(a))]) AS negative_2,
       sha256(a[least(3, len(a))]) AS negative_3 FROM n
"""


def pair_views(spark, sf):
    """Several column-pair training views in one long table (task column)."""
    p = _qa_pairs(spark, sf)
    d = table(spark, sf, "documents")
    views = [
        p.select(F.lit("qa").alias("task"), F.col("query").alias("anchor"), F.col("document").alias("positive")),
        p.select(F.lit("qa_reversed").alias("task"), F.col("document").alias("anchor"),
                 F.col("query").alias("positive")),
        d.select(F.lit("title_body").alias("task"), F.substring_index("text", "\n", 1).alias("anchor"),
                 F.col("text").alias("positive")),
    ]
    out = views[0].unionByName(views[1]).unionByName(views[2])
    return out.select("task", F.sha2("anchor", 256).alias("anchor"), F.sha2("positive", 256).alias("positive"))


QUERIES["pair_views"] = pair_views
ORACLE["pair_views"] = f"""
WITH {_QA_PAIRS_SQL}
SELECT 'qa' AS task, sha256(query) AS anchor, sha256(document) AS positive FROM qp
UNION ALL SELECT 'qa_reversed', sha256(document), sha256(query) FROM qp
UNION ALL SELECT 'title_body', sha256(split_part(text, chr(10), 1)), sha256(text) FROM documents
"""


def pair_views_all(spark, sf):
    """B16, every kind: pairs both ways within a language and across (a document and the next
    longer one of another language), a document's twin (the same number in its language),
    triplets, and scored pairs both ways."""
    qa = qa_rows(spark, sf)
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    at = cut_lineage(positions_in_group(d.select("doc_id", "lang"), ["lang"], ["doc_id"], "at"))
    named = d.join(at.select("doc_id", "at"), "doc_id")

    def of(lang, text):
        return named.where(F.col("lang") == lang).select("at", F.col("text").alias(text))

    twins = of("en", "en").join(of("fr", "fr"), "at")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    scored = twins.join(named.where("lang = 'en'").select("at", "doc_id").join(labels, "doc_id"), "at")
    views = [("qa", qa, {"anchor": "query", "positive": "document"}),
             ("en_fr", twins, {"anchor": "en", "positive": "fr"}), ("fr_en", twins, {"anchor": "fr", "positive": "en"}),
             ("triplet", qa, {"anchor": "query", "positive": "document", "negative": "negative1"}),
             ("scored_en_fr", scored, {"anchor": "en", "positive": "fr", "score": "quality"}),
             ("scored_fr_en", scored, {"anchor": "fr", "positive": "en", "score": "quality"})]
    out = X.column_views(views)
    return out.select("task", *[F.sha2(c, 256).alias(c) for c in ("anchor", "positive", "negative")], "score")


QUERIES["pair_views_all"] = pair_views_all
ORACLE["pair_views_all"] = f"""
WITH {QA_ROWS_SQL},
n AS (SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents),
t AS (SELECT a.doc_id, a.text AS en, b.text AS fr FROM n a JOIN n b USING (k) WHERE a.lang = 'en' AND b.lang = 'fr'),
s AS (SELECT t.*, CAST(quality AS DOUBLE) AS score FROM t JOIN labels USING (doc_id)),
v AS (
  SELECT 'qa' AS task, query AS anchor, document AS positive, NULL AS negative, NULL::DOUBLE AS score FROM qa_rows
  UNION ALL SELECT 'en_fr', en, fr, NULL, NULL FROM t UNION ALL SELECT 'fr_en', fr, en, NULL, NULL FROM t
  UNION ALL SELECT 'triplet', query, document, negative1, NULL FROM qa_rows
  UNION ALL SELECT 'scored_en_fr', en, fr, NULL, score FROM s UNION ALL SELECT 'scored_fr_en', fr, en, NULL, score FROM s)
SELECT task, sha256(anchor) AS anchor, sha256(positive) AS positive, sha256(negative) AS negative, score FROM v
"""


def text_lengths(spark, sf):
    """Whitespace words and characters per document."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.word_count("text").alias("words"), X.char_count("text").alias("chars"))


QUERIES["text_lengths"] = text_lengths
ORACLE["text_lengths"] = f"""
SELECT doc_id, {S.words('text')} AS words, CAST(length(text) AS BIGINT) AS chars FROM documents
"""


def add_prompt(spark, sf):
    """B18: 'query: ' for benchmark items, 'passage: ' for documents."""
    b = table(spark, sf, "benchmark").select(F.lit("query").alias("kind"), F.col("item_id").alias("id"),
                                             X.add_prompt("text", "query: ").alias("text"))
    d = table(spark, sf, "documents").select(F.lit("passage").alias("kind"), F.col("doc_id").alias("id"),
                                             X.add_prompt("text", "passage: ").alias("text"))
    return b.unionByName(d).withColumn("text", F.sha2("text", 256))


QUERIES["add_prompt"] = add_prompt
ORACLE["add_prompt"] = """
SELECT 'query' AS kind, item_id AS id, sha256('query: ' || text) AS text FROM benchmark
UNION ALL SELECT 'passage', doc_id, sha256('passage: ' || text) FROM documents
"""

CORPUS_SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()),
                              T.StructField("language", T.StringType()), T.StructField("source", T.StringType())])


def conform_schema(spark, sf):
    """Select the declared columns and cast to the declared types."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text",
                                             F.col("lang").alias("language"), "source")
    out = d.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CORPUS_SCHEMA.fields])
    return out.withColumn("text", F.sha2("text", 256))


QUERIES["conform_schema"] = conform_schema
ORACLE["conform_schema"] = """
SELECT CAST(doc_id AS VARCHAR) AS id, sha256(text) AS text, lang AS language, source FROM documents
"""


def config_name(spark, sf):
    """A model-id-like string per (lang, source) -> configuration name."""
    d = table(spark, sf, "documents").select("lang", "source").distinct()
    mid = F.concat(F.lit(" "), F.upper("lang"), F.lit("/"), F.col("source"), F.lit("_Embed v1.0/./"))
    return d.select("lang", "source", X.config_name(mid).alias("config"))


QUERIES["config_name"] = config_name
ORACLE["config_name"] = f"""
WITH d AS (SELECT DISTINCT lang, source, ' ' || upper(lang) || '/' || source || '_Embed v1.0/./' AS mid FROM documents),
p AS (SELECT lang, source, list_transform(string_split({S.strip('mid')}, '/'),
        lambda x: regexp_replace(regexp_replace(lower(x), '[^a-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g')) AS parts FROM d)
SELECT lang, source, array_to_string(list_filter(parts, lambda x: x <> ''), '--') AS config FROM p
"""


def row_max(spark, sf):
    """Max of several score columns (NULL and NaN skipped)."""
    li = table(spark, sf, "lineitem")
    cols = ["l_discount", "l_tax"]
    return li.select("l_orderkey", "l_linenumber",
                     F.greatest(*[F.nanvl(F.col(c), F.lit(None).cast("double")) for c in cols]).alias("row_max"))


QUERIES["row_max"] = row_max
ORACLE["row_max"] = "SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax) AS row_max FROM lineitem"


def build_request_items(spark, sf):
    """Benchmark items in batches of 8 (by item id) as JSON arrays."""
    b = table(spark, sf, "benchmark")
    idx = global_index(b, ["item_id"], "_i").withColumn("batch", F.floor(F.col("_i") / 8))
    out = request_items(idx, ["batch"], "item_id", "text")
    return out.select(F.col("batch").cast("bigint").alias("batch"), F.sha2("items", 256).alias("items"))


QUERIES["build_request_items"] = build_request_items
ORACLE["build_request_items"] = """
WITH b AS (SELECT item_id, text, (row_number() OVER (ORDER BY item_id) - 1) // 8 AS batch FROM benchmark)
SELECT CAST(batch AS BIGINT) AS batch, sha256(to_json(list({'id': item_id, 'text': text} ORDER BY item_id))) AS items
FROM b GROUP BY batch
"""


def parse_response(spark, sf):
    """Validate generated responses for benchmark batches: correct
    replies, fenced replies, a dropped item, a wrong id, a blank item and a
    non-JSON reply, chosen by the batch number."""
    b = table(spark, sf, "benchmark")
    idx = global_index(b, ["item_id"], "_i").withColumn("batch", F.floor(F.col("_i") / 8))
    grp = idx.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct(
        F.col("item_id").cast("string").alias("id"), F.upper("text").alias("translation")))).alias("tr"))
    kind = F.pmod(F.col("batch"), F.lit(6))
    good = F.to_json(F.struct(F.col("tr").alias("translations")))
    resp = (F.when(kind == 0, good)
            .when(kind == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
            .when(kind == 2, F.to_json(F.struct(F.slice(F.col("tr"), F.lit(2), F.size("tr")).alias("translations"))))
            .when(kind == 3, F.to_json(F.struct(F.transform("tr", lambda t: F.struct(
                F.concat(t["id"], F.lit("x")).alias("id"), t["translation"].alias("translation")))
                .alias("translations"))))
            .when(kind == 4, F.to_json(F.struct(F.transform("tr", lambda t: F.struct(
                t["id"].alias("id"), F.lit("  ").alias("translation"))).alias("translations"))))
            .otherwise(F.lit("not json")))
    expected = F.transform("tr", lambda t: t["id"])
    r = grp.select("batch", parse_reply(resp, expected).alias("r"))
    return r.select(F.col("batch").cast("bigint").alias("batch"), "r.status", "r.reason",
                    F.size("r.translations").alias("items"))


QUERIES["parse_response"] = parse_response
ORACLE["parse_response"] = f"""
WITH i AS (SELECT text, (row_number() OVER (ORDER BY item_id) - 1) // 8 AS batch FROM benchmark),
b AS (SELECT batch, count(*) AS n, bool_or({S.strip('text')} = '') AS blank FROM i GROUP BY batch),
r AS (SELECT batch, n, CASE WHEN batch % 6 IN (0, 1) THEN CASE WHEN blank THEN 'blank' END WHEN batch % 6 = 2 THEN 'count'
                            WHEN batch % 6 = 3 THEN 'ids' WHEN batch % 6 = 4 THEN 'blank' ELSE 'shape' END AS reason FROM b)
SELECT CAST(batch AS BIGINT) AS batch, CASE WHEN reason IS NULL THEN 'ok' ELSE 'error' END AS status, reason,
       CASE WHEN reason IS NULL THEN CAST(n AS INTEGER) END AS items FROM r
"""
