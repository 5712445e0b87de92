"""Source divergence audit: how far the word use of each source departs from the
other sources of its language, and by which terms.

Count-cell ranking. The terms of a group that share (count in the group, count in
the language) share one score, so a score is computed once per such cell. Cells of
equal score are merged, their cumulative multiplicity gives the rank at which each
score begins, and only the scores that begin within the wanted ranks are expanded
into terms, in UTF-8 order. Between two sources the cells are count profiles: kept
terms with the same counts in all sources are one profile with a multiplicity.

Texts are counted in tasks (one row per term, source and block of documents leaves
a task), so a frequent term or a hot source costs a few rows per task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import BROADCAST_KEYS, kept, shards_for, trim

#: probabilities are whole numbers out of this
SCALE = 1_000_000_000
#: counters of a task are sent on at this many entries
_ENTRIES = 1 << 18
#: numbers in one tile of the comparison of sources
_TILE = 1 << 21

#: bytes that end a term are white space after translation, A-Z becomes a-z
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, rows that hold it) of this task."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows():
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms)), pa.array([source] * len(terms)),
                 pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()),
                 pa.array(map(docs.__getitem__, terms), pa.int64())], ["lang", "source", "term", "n", "docs"])

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = text.translate(_TERM_BYTES).split(b" ")
            if (lang, source) not in held:
                held[lang, source] = Counter(), Counter()
            n, docs = held[lang, source]
            size -= len(n)
            n.update(words)
            docs.update(set(words))
            del n[b""], docs[b""]
            size += len(n)
            if size >= _ENTRIES:
                yield from rows()
                held, size = {}, 0
                trim()
    yield from rows()
    held = {}
    trim()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
                min_docs: int = 3) -> DataFrame:
    """(lang, term, n, per): the terms in at least ``min_docs`` rows of their language,
    their occurrences there, and an array of (source, n) sorted by source."""
    view = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                       F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
                       F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    counted = (view.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
               .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    # a term has one row per source here, so this list is as long as the sources of a language
    return (counted.groupBy("lang", "term")
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"),
                 F.sort_array(F.collect_list(F.struct("source", "n"))).alias("per"))
            .where(F.col("docs") >= min_docs).drop("docs"))


def probability(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kinds)), exact for any counts."""
    top = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, (total + kinds).cast("decimal(20,0)"))


def departure(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); both are at most SCALE + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _small(df: DataFrame, bound: int = BROADCAST_KEYS) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if it has at most ``bound`` rows."""
    return F.broadcast(df) if df.count() <= bound else df


def _top_terms(terms: DataFrame, groups: DataFrame, cells: DataFrame, most: int) -> DataFrame:
    """The ``most`` first (term, value) of each group, by cells."""
    scored = (cells.join(_small(groups), ["lang", "source"])
              .withColumn("p", probability(F.col("cg"), F.col("n"), F.col("kinds")))
              .withColumn("q", probability(F.col("cl"), F.col("lang_n"), F.col("kinds")))
              .where(F.col("p") > F.col("q"))
              .select("lang", "source", "cg", "cl", "m", departure(F.col("p"), F.col("q")).alias("value")))
    scored = kept(scored, "divergence-cells")
    merged = scored.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    # a value holds one term at least: the first ``most`` values of a group reach far enough
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    first = merged.withColumn("k", F.row_number().over(by_value)).where(F.col("k") <= most)
    begins = first.withColumn("before", F.coalesce(
        F.sum("m").over(by_value.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    begins = begins.where(F.col("before") < most).select("lang", "source", "value", "before")
    wanted = kept(scored.join(begins, ["lang", "source", "value"]).select("lang", "source", "cg", "cl", "value", "before"),
                  "divergence-wanted")
    rows = terms.join(_small(wanted), ["lang", "source", "cg", "cl"])
    in_value = Window.partitionBy("lang", "source", "value").orderBy("term")
    return (rows.withColumn("k", F.row_number().over(in_value)).where(F.col("k") <= most)
            .withColumn("rank", (F.col("before") + F.col("k")).cast("int")).where(F.col("rank") <= most)
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))


def _p(counts: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """``probability`` of an array of counts, each distinct count once, in whole numbers."""
    u, at = np.unique(counts, return_inverse=True)
    return np.array([1 + SCALE * (c + 1) // (total + kinds) for c in u.tolist()], np.int64)[at]


def _compare(key, profiles: pa.Table, groups: pa.Table) -> pa.Table:
    """For each two sources of one language, the sum over the profiles of a shard of
    the departure less that of a term that neither source holds."""
    names = groups.column("source").to_pylist()
    n, kinds = groups.column("n").to_pylist(), groups.column("kinds").to_pylist()
    code = {s: i for i, s in enumerate(names)}
    found = np.zeros((len(names), len(names)), np.int64)
    if profiles.num_rows and names:
        none = np.array([_p(np.zeros(1, np.int64), a, k)[0] for a, k in zip(n, kinds, strict=True)])
        base = (none[:, None] - none[None, :]) ** 2 // none[None, :]
        per = profiles.column("per").combine_chunks()
        times = profiles.column("m").to_numpy()
        offsets = per.offsets.to_numpy()
        flat = per.flatten()
        coded = flat.field("source").dictionary_encode()
        source = np.array([code[s] for s in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
        counts = flat.field("n").to_numpy()
        p = np.empty(len(counts), np.int64)
        for g in range(len(names)):
            mine = source == g
            p[mine] = _p(counts[mine], n[g], kinds[g])
        offsets = offsets - offsets[0]
        row = np.repeat(np.arange(len(times)), np.diff(offsets))
        step = max(1, _TILE // len(names))
        for lo in range(0, len(times), step):
            hi = min(lo + step, len(times))
            a, z = int(offsets[lo]), int(offsets[hi])
            tile, held = np.tile(none, (hi - lo, 1)), np.zeros((hi - lo, len(names)), bool)
            tile[row[a:z] - lo, source[a:z]] = p[a:z]
            held[row[a:z] - lo, source[a:z]] = True
            for g in np.flatnonzero(held.any(axis=0)):
                at = np.flatnonzero(held[:, g])
                mine, other, m = tile[at, g][:, None], tile[at], times[lo + at][:, None]
                square = (mine - other) ** 2
                found[g] += (m * (square // other - base[g])).sum(axis=0)
                # the reverse for sources without the term; those with it have a turn of their own
                found[:, g] += np.where(held[at], 0, m * (square // mine - base[:, g])).sum(axis=0)
    g, h = np.nonzero(found)
    return pa.table({"lang": pa.array([key[0].as_py()] * len(g), pa.string()),
                     "source": pa.array([names[i] for i in g], pa.string()),
                     "item": pa.array([names[i] for i in h], pa.string()), "part_sum": pa.array(found[g, h])})


def _pairs(counts: DataFrame, groups: DataFrame, n_shards: int) -> DataFrame:
    """Every two sources of a language with the departure summed over its kept terms."""
    profiles = counts.groupBy("lang", "per").agg(F.count(F.lit(1)).alias("m"))
    sharded = profiles.withColumn("shard", F.pmod(F.xxhash64("per"), F.lit(n_shards)).cast("int"))
    spread = groups.select("lang", "source", "n", "kinds",
                           F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"))
    sums = (sharded.groupBy("lang", "shard").cogroup(spread.groupBy("lang", "shard"))
            .applyInArrow(_compare, "lang string, source string, item string, part_sum long")
            .groupBy("lang", "source", "item").agg(F.sum("part_sum").alias("part_sum")))
    zero = F.lit(0).cast("long")
    none = groups.select("lang", "source", "kinds", probability(zero, F.col("n"), F.col("kinds")).alias("none"))
    other = none.select("lang", F.col("source").alias("item"), F.col("none").alias("other_none"))
    # the result itself has a row for each two sources of a language
    rows = none.join(other, "lang").where(F.col("source") != F.col("item")).join(sums, ["lang", "source", "item"], "left")
    value = F.when(F.col("kinds") == 0, zero).otherwise(
        F.coalesce("part_sum", zero) + F.col("kinds") * departure(F.col("none"), F.col("other_none")))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (rows.withColumn("value", value).withColumn("rank", F.row_number().over(place).cast("int"))
            .select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank"))


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
                      min_docs: int = 3, most: int = 200, n_shards: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group of ``docs``.

    Part ``pair`` ranks the other sources of the language, part ``term`` the terms
    that the group uses more than its language, the first ``most``. Terms are runs
    of letters and non-ASCII characters, only A-Z in lower case; a language keeps
    those in at least ``min_docs`` rows. A null lang, source or text is empty. A
    group without kept terms has pairs and no terms; a language without kept terms
    gives pairs of value 0; one without a second source no pairs. Repeated rows
    count each. Ties are in UTF-8 order of the item. Other columns are ignored. An
    empty table gives no rows. Whole texts and all terms are counted.
    """
    name = F.coalesce(F.col(lang_col).cast("string"), F.lit("")), F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    shards = n_shards or shards_for(docs)
    counts = kept(term_counts(docs, lang_col, source_col, text_col, min_docs), "divergence-terms")
    terms = (counts.select("lang", "term", F.col("n").alias("cl"), F.explode("per").alias("s"))
             .select("lang", F.col("s.source").alias("source"), "term", F.col("s.n").alias("cg"), "cl"))
    cells = kept(terms.groupBy("lang", "source", "cg", "cl").agg(F.count(F.lit(1)).alias("m")), "divergence-counts")
    totals = cells.groupBy("lang", "source").agg(F.sum(F.col("cg") * F.col("m")).alias("n"))
    langs = counts.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("lang_n"))
    every = docs.select(name[0].alias("lang"), name[1].alias("source")).distinct()
    zero = F.lit(0).cast("long")
    groups = kept(every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
                  .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n", "kinds", "lang_n")]),
                  "divergence-groups")
    return _top_terms(terms, groups, cells, most).unionByName(_pairs(counts, groups, shards))


#: the same for the registered query (terms in 3 documents, 200 ranks)
ORACLE_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
tok AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (
  SELECT lang, term, count(*) AS cl FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
grouped AS (
  SELECT lang, source, term, count(*) AS cg FROM tok SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, count(*) AS v, sum(cl) AS nl FROM kept GROUP BY lang),
groups AS (
  SELECT e.lang, e.source, coalesce(n, 0) AS n, coalesce(v, 0) AS v, coalesce(nl, 0) AS nl
  FROM (SELECT DISTINCT lang, source FROM d) e
  LEFT JOIN (SELECT lang, source, sum(cg) AS n FROM grouped GROUP BY lang, source) USING (lang, source)
  LEFT JOIN langs USING (lang)),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(cg, 0) AS cg,
         1 + 1000000000::HUGEINT * (coalesce(cg, 0) + 1) // (g.n + g.v) AS p,
         1 + 1000000000::HUGEINT * (k.cl + 1) // (g.nl + g.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN grouped c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value,
         row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // q DESC, term) AS rank
  FROM cells WHERE cg > 0 AND p > q),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM terms WHERE rank <= 200
UNION ALL
SELECT lang, source, part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
"""
