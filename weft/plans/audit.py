"""Registered integrity and composition queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.text import char_count, normalize_query, script_class, word_count
from weft.operators import profile as P
from weft.operators import quality as Q
from weft.plans import sqlfrag as S
from weft.plans.fixtures import CORPUS_SPLIT_SQL, QA_ROWS_SQL, corpus_with_split, qa_rows
from weft.session import table
from weft.sources import files as IO

QUERIES: dict = {}
ORACLE: dict = {}

# Normalized query, SQL side: SQL has no casefold; of the letters that occur only the
# sharp s folds to something else than its lower case.
NORM_SQL = (f"regexp_replace(regexp_replace(regexp_replace(replace(lower(query), 'ß', 'ss'), "
            f"'[^\\p{{L}}\\p{{N}}_{S.SPLIT_SQL[1:-2]}]', ' ', 'g'), '{S.SPLIT_SQL}', ' ', 'g'), "
            f"'{S.STRIP_SQL}', '', 'g')")


KEY_SQL = f"sha256({NORM_SQL})"


def query_key(col="query"):
    """The hash of the whole normalized text: keys of bounded size, whatever the texts."""
    return F.sha2(normalize_query(col), 256)


def dup_summary(spark, sf):
    qa = qa_rows(spark, sf)
    exact = Q.dup_summary(qa, F.sha2("query", 256), "exact_")
    norm = Q.dup_summary(qa, query_key(), "norm_")
    return exact.crossJoin(norm)  # two one-row tables


QUERIES["dup_summary"] = dup_summary
ORACLE["dup_summary"] = f"""
WITH {QA_ROWS_SQL},
e AS (SELECT query AS k, count(*) AS n FROM qa_rows GROUP BY 1),
m AS (SELECT {KEY_SQL} AS k, count(*) AS n FROM qa_rows GROUP BY 1)
SELECT CAST((SELECT sum(n) FROM e) AS BIGINT) AS exact_rows, (SELECT count(*) FROM e) AS exact_distinct,
       CAST((SELECT sum(n) - count(*) FROM e) AS BIGINT) AS exact_duplicate_rows,
       (SELECT count(*) FROM e WHERE n > 1) AS exact_duplicate_groups,
       CAST((SELECT sum(n) FROM m) AS BIGINT) AS norm_rows, (SELECT count(*) FROM m) AS norm_distinct,
       CAST((SELECT sum(n) - count(*) FROM m) AS BIGINT) AS norm_duplicate_rows,
       (SELECT count(*) FROM m WHERE n > 1) AS norm_duplicate_groups
"""


def dup_details(spark, sf):
    qa = qa_rows(spark, sf).select("query", "category", F.sha2("document", 256).alias("document"))
    return Q.dup_details(qa, query_key(), "category", "document")


QUERIES["dup_details"] = dup_details
ORACLE["dup_details"] = f"""
WITH {QA_ROWS_SQL},
k AS (SELECT {KEY_SQL} AS key, * FROM qa_rows)
SELECT key, count(*) AS occurrences, list_sort(list_distinct(list(category))) AS categories,
       count(DISTINCT document) AS distinct_positives
FROM k GROUP BY key HAVING count(*) > 1
"""


def dup_members(spark, sf):
    return Q.dup_members(qa_rows(spark, sf), query_key(), "row_id")


QUERIES["dup_members"] = dup_members
ORACLE["dup_members"] = f"""
WITH {QA_ROWS_SQL},
k AS (SELECT {KEY_SQL} AS key, row_id FROM qa_rows)
SELECT key, row_id FROM k WHERE key IN (SELECT key FROM k GROUP BY key HAVING count(*) > 1)
"""


def null_empty_counts(spark, sf):
    return Q.null_empty_counts(table(spark, sf, "conversations"), ["conv_id", "turn", "role", "text"])


QUERIES["null_empty_counts"] = null_empty_counts
ORACLE["null_empty_counts"] = f"""
SELECT 'conv_id' AS "column", CAST(count_if(conv_id IS NULL) AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS empty FROM conversations
UNION ALL SELECT 'turn', CAST(count_if(turn IS NULL) AS BIGINT), 0 FROM conversations
UNION ALL SELECT 'role', CAST(count_if(role IS NULL) AS BIGINT), CAST(count_if({S.strip('role')} = '') AS BIGINT) FROM conversations
UNION ALL SELECT 'text', CAST(count_if(text IS NULL) AS BIGINT), CAST(count_if({S.strip('text')} = '') AS BIGINT) FROM conversations
"""


def id_gaps(spark, sf):
    return Q.id_gaps(table(spark, sf, "labels"), "doc_id")


QUERIES["id_gaps"] = id_gaps
ORACLE["id_gaps"] = """
WITH ids AS (SELECT DISTINCT doc_id AS id FROM labels),
n AS (SELECT id, lead(id) OVER (ORDER BY id) AS nxt FROM ids)
SELECT id + 1 AS start, nxt - 1 AS stop, CAST(nxt - id - 1 AS BIGINT) AS missing FROM n WHERE nxt > id + 1
"""


def duplicate_ids(spark, sf):
    return Q.duplicate_ids(table(spark, sf, "lineitem"), "l_orderkey")


QUERIES["duplicate_ids"] = duplicate_ids
ORACLE["duplicate_ids"] = """
SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1
"""


def label_collision(spark, sf):
    qa = qa_rows(spark, sf)
    flag = Q.label_collision(qa, "document", ["negative1", "negative2", "negative3"])
    return qa.groupBy("category").agg(F.count_if(flag).alias("collisions"),
                                      F.count(F.lit(1)).alias("rows"))


QUERIES["label_collision"] = label_collision
ORACLE["label_collision"] = f"""
WITH {QA_ROWS_SQL}
SELECT category, CAST(count_if(document IN (negative1, negative2, negative3)) AS BIGINT) AS collisions,
       count(*) AS rows FROM qa_rows GROUP BY 1
"""


def candidate_dictionary(spark, sf):
    """Unique texts over document + negatives, numbered by first sight
    (row order, then column order)."""
    from weft.operators.ordering import global_index
    qa = qa_rows(spark, sf)
    stacked = Q.candidate_texts(qa, "row_id", ["document", "negative1", "negative2", "negative3"])
    first = (stacked.groupBy(F.sha2("text", 256).alias("text_hash"))
             .agg(F.min("_ord").alias("_ord")))
    idx = global_index(first, ["_ord"], "doc_index")
    return idx.select("text_hash", "doc_index",
                      F.col("_ord.row_id").alias("first_row"), F.col("_ord._pos").alias("first_col"))


QUERIES["candidate_dictionary"] = candidate_dictionary
ORACLE["candidate_dictionary"] = f"""
WITH {QA_ROWS_SQL},
st AS (SELECT row_id, 0 AS pos, document AS text FROM qa_rows
       UNION ALL SELECT row_id, 1, negative1 FROM qa_rows
       UNION ALL SELECT row_id, 2, negative2 FROM qa_rows
       UNION ALL SELECT row_id, 3, negative3 FROM qa_rows),
f AS (SELECT sha256(text) AS text_hash, min(row_id * 4 + pos) AS o FROM st GROUP BY 1)
SELECT text_hash, row_number() OVER (ORDER BY o) - 1 AS doc_index,
       o // 4 AS first_row, CAST(o % 4 AS INTEGER) AS first_col FROM f
"""


def split_leakage(spark, sf):
    """Texts whose copies (other sources) fell into both splits."""
    c = corpus_with_split(spark, sf)
    return Q.split_leakage(c, F.sha2("text", 256))


QUERIES["split_leakage"] = split_leakage
ORACLE["split_leakage"] = f"""
WITH {CORPUS_SPLIT_SQL},
d AS (SELECT DISTINCT sha256(text) AS key, split FROM corpus_split)
SELECT key, count(*) AS splits, list_sort(list(split)) AS split_names FROM d
GROUP BY key HAVING count(*) > 1
"""


def integrity_report(spark, sf):
    """(check, count) for the retrieval rows."""
    qa = qa_rows(spark, sf)
    neg = ["negative1", "negative2", "negative3"]
    row = qa.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("query").isNull() | (F.col("query") == "")).alias("empty_queries"),
        F.count_if(Q.label_collision(qa, "document", neg)).alias("positive_in_negatives"),
        F.count_if(F.size(F.array_distinct(F.array("document", *neg))) < 4).alias("repeated_candidates"),
        (F.count(F.lit(1)) - F.countDistinct("query")).alias("duplicate_query_rows"),
        (F.count(F.lit(1)) - F.countDistinct("row_id")).alias("duplicate_row_ids"))
    names = ["rows", "empty_queries", "positive_in_negatives", "repeated_candidates",
             "duplicate_query_rows", "duplicate_row_ids"]
    return Q.stack_checks(row, names)


QUERIES["integrity_report"] = integrity_report
ORACLE["integrity_report"] = f"""
WITH {QA_ROWS_SQL},
r AS (SELECT count(*) AS rows, CAST(count_if(query IS NULL OR query = '') AS BIGINT) AS empty_queries,
             CAST(count_if(document IN (negative1, negative2, negative3)) AS BIGINT) AS positive_in_negatives,
             CAST(count_if(len(list_distinct([document, negative1, negative2, negative3])) < 4) AS BIGINT) AS repeated_candidates,
             count(*) - count(DISTINCT query) AS duplicate_query_rows,
             count(*) - count(DISTINCT row_id) AS duplicate_row_ids FROM qa_rows)
SELECT 'rows' AS "check", CAST(rows AS BIGINT) AS count FROM r
UNION ALL SELECT 'empty_queries', empty_queries FROM r
UNION ALL SELECT 'positive_in_negatives', positive_in_negatives FROM r
UNION ALL SELECT 'repeated_candidates', repeated_candidates FROM r
UNION ALL SELECT 'duplicate_query_rows', duplicate_query_rows FROM r
UNION ALL SELECT 'duplicate_row_ids', duplicate_row_ids FROM r
"""


QA_SCHEMA = ("row_id bigint, query string, document string, negative1 string, negative2 string, negative3 string, "
             "category string, language string")


def integrity_checks(spark, sf):
    """C9, all checks, on the retrieval rows read from NDJSON in which every 40th line is cut
    short; ``title`` is required and not there."""
    qa = qa_rows(spark, sf)
    line = F.to_json(F.struct("*"))
    cut = F.when(F.col("row_id") % 40 == 0, F.substring(line, 1, 30)).otherwise(line)
    path = IO.scratch_path(spark, "integrity")
    qa.select(cut.alias("value")).write.option("compression", "gzip").text(path)  # five texts a line
    good, bad = IO.scan_ndjson_audit(spark, path, QA_SCHEMA)
    negatives = ["negative1", "negative2", "negative3"]
    return Q.integrity_checks(good, bad, ["row_id", "query", "document", *negatives, "category", "language", "title"],
                              "row_id", "query", "document", negatives, query_key())


QUERIES["integrity_checks"] = integrity_checks
ORACLE["integrity_checks"] = f"""
WITH {QA_ROWS_SQL},
good AS (SELECT * FROM qa_rows WHERE row_id % 40 <> 0),
e AS (SELECT query AS k, count(*) AS n FROM good GROUP BY 1),
m AS (SELECT {KEY_SQL} AS k, count(*) AS n FROM good GROUP BY 1),
c AS (SELECT document AS t FROM good UNION SELECT negative1 FROM good UNION SELECT negative2 FROM good
      UNION SELECT negative3 FROM good),
texts AS (SELECT unnest([query, document, negative1, negative2, negative3, category, language]) AS t FROM good)
SELECT 'parse_errors' AS "check", CAST(count(*) AS BIGINT) AS count FROM qa_rows WHERE row_id % 40 = 0
UNION ALL SELECT 'missing_columns', 1
UNION ALL SELECT 'null_values', CAST(count_if(t IS NULL) AS BIGINT) FROM texts
UNION ALL SELECT 'empty_strings', CAST(count_if({S.strip('t')} = '') AS BIGINT) FROM texts
UNION ALL SELECT 'duplicate_row_ids', count(*) - count(DISTINCT row_id) FROM good
UNION ALL SELECT 'missing_row_ids', max(row_id) - min(row_id) + 1 - count(DISTINCT row_id) FROM good
UNION ALL SELECT 'duplicate_query_rows', CAST(sum(n - 1) AS BIGINT) FROM e
UNION ALL SELECT 'duplicate_query_groups', CAST(count_if(n > 1) AS BIGINT) FROM e
UNION ALL SELECT 'normalized_duplicate_query_rows', CAST(sum(n - 1) AS BIGINT) FROM m
UNION ALL SELECT 'collision_rows', CAST(count_if(document IN (negative1, negative2, negative3)) AS BIGINT) FROM good
UNION ALL SELECT 'unique_candidates', count(*) FROM c
"""


# ---- D: composition ----

def share_by_group(spark, sf):
    return P.share_by_group(table(spark, sf, "documents"), ["lang"])


QUERIES["share_by_group"] = share_by_group
ORACLE["share_by_group"] = """
SELECT lang, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct
FROM documents GROUP BY lang
"""

_DL_SQL = """dl AS (SELECT d.lang, d.source, CAST(l.quality AS VARCHAR) AS quality,
                           CAST(l.toxic AS VARCHAR) AS toxic
                    FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _docs_labels(spark, sf):
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels")
    return d.join(lab, "doc_id", "left").select(
        "lang", "source", F.col("quality").cast("string").alias("quality"),
        F.col("toxic").cast("string").alias("toxic"))


def value_counts_multi(spark, sf):
    return P.value_counts_multi(_docs_labels(spark, sf), ["lang", "source", "quality", "toxic"])


QUERIES["value_counts_multi"] = value_counts_multi
ORACLE["value_counts_multi"] = f"""
WITH {_DL_SQL},
u AS (SELECT 'lang' AS dimension, lang AS value FROM dl UNION ALL SELECT 'source', source FROM dl
      UNION ALL SELECT 'quality', quality FROM dl UNION ALL SELECT 'toxic', toxic FROM dl),
c AS (SELECT dimension, value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT dimension, value, n, round(n * 100.0 / sum(n) OVER (PARTITION BY dimension), 2) AS pct FROM c
"""


def pivot_counts(spark, sf):
    """D3: field x script class for the query and document fields."""
    qa = qa_rows(spark, sf)
    st = P.stack_fields(qa, ["query", "document"])
    classes = ["Devanagari + Latin", "Devanagari only", "Latin only", "Other"]
    out = P.pivot_counts(st.withColumn("script", script_class("text")), "field", "script", classes)
    return out.select("field", *[F.col(f"`{c}`").cast("bigint").alias(c.replace(" + ", "_").replace(" ", "_"))
                                 for c in classes])


QUERIES["pivot_counts"] = pivot_counts
_SCRIPT_SQL = """CASE WHEN regexp_matches(text, '[\\x{0900}-\\x{097F}]') AND regexp_matches(text, '[A-Za-z]') THEN 'Devanagari + Latin'
     WHEN regexp_matches(text, '[\\x{0900}-\\x{097F}]') THEN 'Devanagari only'
     WHEN regexp_matches(text, '[A-Za-z]') THEN 'Latin only' ELSE 'Other' END"""
ORACLE["pivot_counts"] = f"""
WITH {QA_ROWS_SQL},
st AS (SELECT 'query' AS field, query AS text FROM qa_rows UNION ALL SELECT 'document', document FROM qa_rows),
c AS (SELECT field, {_SCRIPT_SQL} AS script FROM st)
SELECT field, CAST(count_if(script = 'Devanagari + Latin') AS BIGINT) AS Devanagari_Latin,
       CAST(count_if(script = 'Devanagari only') AS BIGINT) AS Devanagari_only,
       CAST(count_if(script = 'Latin only') AS BIGINT) AS Latin_only, CAST(count_if(script = 'Other') AS BIGINT) AS Other
FROM c GROUP BY field
"""


def crosstab(spark, sf):
    """Event type x weekday (1 = Sunday .. 7 = Saturday)."""
    e = table(spark, sf, "events").withColumn("weekday", F.dayofweek("ts").cast("string"))
    out = P.pivot_counts(e, "event_type", "weekday", [str(i) for i in range(1, 8)])
    return out.select("event_type", *[F.col(str(i)).cast("bigint").alias(f"d{i}") for i in range(1, 8)])


QUERIES["crosstab"] = crosstab
ORACLE["crosstab"] = "SELECT event_type, " + ", ".join(
    f"CAST(count_if(dayofweek(ts) + 1 = {i}) AS BIGINT) AS d{i}" for i in range(1, 8)) + " FROM events GROUP BY 1"


def _lengths(spark, sf, fields=("query", "document", "negative1")):
    qa = qa_rows(spark, sf)
    st = P.stack_fields(qa, fields)
    return st.select("field", word_count("text").alias("words"), char_count("text").alias("chars"))


_LEN_SQL = f"""
st AS (SELECT 'query' AS field, query AS text FROM qa_rows UNION ALL SELECT 'document', document FROM qa_rows
       UNION ALL SELECT 'negative1', negative1 FROM qa_rows),
ln AS (SELECT field, {S.words('text')} AS words, CAST(length(text) AS BIGINT) AS chars FROM st)"""


_TEXT_COLUMNS = ["query", "document", "negative1", "negative2", "negative3"]
_ALL_LEN_SQL = _LEN_SQL.replace("),\nln AS", "".join(
    f"\n       UNION ALL SELECT '{c}', {c} FROM qa_rows" for c in _TEXT_COLUMNS[3:]) + "),\nln AS")


def length_summary(spark, sf):
    """Lengths of all five text columns."""
    return P.length_summary(_lengths(spark, sf, _TEXT_COLUMNS))


QUERIES["length_summary"] = length_summary
ORACLE["length_summary"] = f"""
WITH {QA_ROWS_SQL}, {_ALL_LEN_SQL}
SELECT field, min(words) AS min_words, round(median(words), 6) AS median_words,
       round(avg(words), 6) AS mean_words, max(words) AS max_words,
       round(median(chars), 6) AS median_chars, round(avg(chars), 6) AS mean_chars
FROM ln GROUP BY field
"""


def box_stats(spark, sf):
    return P.box_stats(_lengths(spark, sf))


QUERIES["box_stats"] = box_stats
ORACLE["box_stats"] = f"""
WITH {QA_ROWS_SQL}, {_LEN_SQL}
SELECT field, min(words) AS lo, round(quantile_cont(words, 0.25), 6) AS q1,
       round(quantile_cont(words, 0.5), 6) AS q2, round(quantile_cont(words, 0.75), 6) AS q3,
       max(words) AS hi FROM ln GROUP BY field
"""


def confounding(spark, sf):
    return P.confounding(table(spark, sf, "documents"), "lang", "source")


QUERIES["confounding"] = confounding
ORACLE["confounding"] = """
WITH p AS (SELECT DISTINCT lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
a AS (SELECT max(k) AS m FROM (SELECT lang, count(*) AS k FROM p GROUP BY 1)),
b AS (SELECT max(k) AS m FROM (SELECT source, count(*) AS k FROM p GROUP BY 1))
SELECT a.m = 1 AS lang_determines_source, b.m = 1 AS source_determines_lang,
       a.m = 1 AND b.m = 1 AS one_to_one FROM a, b
"""


def factor_coverage(spark, sf):
    return P.factor_coverage(_docs_labels(spark, sf), ["lang", "source", "quality", "toxic"])


QUERIES["factor_coverage"] = factor_coverage
ORACLE["factor_coverage"] = f"""
WITH {_DL_SQL},
o AS (SELECT count(*) AS observed FROM (SELECT DISTINCT lang, source, quality, toxic FROM dl)),
c AS (SELECT count(DISTINCT lang) * count(DISTINCT source) * count(DISTINCT quality)
             * count(DISTINCT toxic) AS possible FROM dl)
SELECT observed, possible, round(observed / possible, 6) AS coverage FROM o, c
"""


def fingerprint(spark, sf):
    return P.fingerprint(corpus_with_split(spark, sf), "id")


QUERIES["fingerprint"] = fingerprint
ORACLE["fingerprint"] = f"""
WITH {CORPUS_SPLIT_SQL},
h AS (SELECT sha256(id) AS h FROM corpus_split),
s AS (SELECT count(*) AS rows,
             sum(('0x' || substr(h, 1, 16))::UBIGINT::HUGEINT) AS s1,
             sum(('0x' || substr(h, 17, 16))::UBIGINT::HUGEINT) AS s2 FROM h)
SELECT rows, sha256(CAST(rows AS VARCHAR) || ':' || CAST(s1 % 18446744073709551616 AS VARCHAR) || ':'
                    || CAST(s2 % 18446744073709551616 AS VARCHAR)) AS fingerprint FROM s
"""


def split_coverage(spark, sf):
    return P.split_coverage(corpus_with_split(spark, sf), "split", ["lang", "source"])


QUERIES["split_coverage"] = split_coverage
ORACLE["split_coverage"] = f"""
WITH {CORPUS_SPLIT_SQL}
SELECT split, count(*) AS rows, count(DISTINCT lang) AS distinct_lang,
       count(DISTINCT source) AS distinct_source FROM corpus_split GROUP BY split
"""


def split_distribution(spark, sf):
    c = corpus_with_split(spark, sf)
    return P.value_counts_multi(c, ["lang", "source"], by=["split"])


QUERIES["split_distribution"] = split_distribution
ORACLE["split_distribution"] = f"""
WITH {CORPUS_SPLIT_SQL},
u AS (SELECT split, 'lang' AS dimension, lang AS value FROM corpus_split
      UNION ALL SELECT split, 'source', source FROM corpus_split),
c AS (SELECT split, dimension, value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY 1, 2, 3)
SELECT split, dimension, value, n,
       round(n * 100.0 / sum(n) OVER (PARTITION BY split, dimension), 2) AS pct FROM c
"""


def composition_overview(spark, sf):
    return P.composition_overview(
        P.value_counts_multi(_docs_labels(spark, sf), ["lang", "source", "quality", "toxic"]))


QUERIES["composition_overview"] = composition_overview
ORACLE["composition_overview"] = f"""
WITH {_DL_SQL},
u AS (SELECT 'lang' AS dimension, lang AS value FROM dl UNION ALL SELECT 'source', source FROM dl
      UNION ALL SELECT 'quality', quality FROM dl UNION ALL SELECT 'toxic', toxic FROM dl),
c AS (SELECT dimension, value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT dimension, count(*) AS "values", min(n) AS min_rows, max(n) AS max_rows FROM c GROUP BY 1
"""


def perplexity(spark, sf):
    """exp(min(mean loss, 20)) per event type, treating value as a loss."""
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.round(P.perplexity(F.col("value")), 6).alias("perplexity"))


QUERIES["perplexity"] = perplexity
ORACLE["perplexity"] = """
SELECT event_type, round(exp(least(avg(value), 20)), 6) AS perplexity FROM events GROUP BY 1
"""
