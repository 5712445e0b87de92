"""Text column expressions (cleaning, merging, scripts, lengths, prompts).

Everything here returns a ``Column`` built from JVM-side functions, so it
stays inside whole-stage codegen. The one exception is ``normalize_query``,
whose NFKC + casefold step has no Spark equivalent and runs as an
Arrow-batched pandas UDF.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.strip()/str.split() treat as
# whitespace, and the sentinel texts a cleaner turns into the empty string.
PY_WHITESPACE = (
    r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# The same whitespace set as literal characters, for trim().
PY_WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                       "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                       "\u2028\u2029\u202f\u205f\u3000")
SENTINELS = ("[deleted]", "[removed]", "deleted", "removed")
SENTINELS_CASE_SENSITIVE = ("[deleted]", "[removed]")
TEXT_FIELDS = ("title", "selftext", "body", "text", "content")
DEVANAGARI = r"\x{0900}-\x{097F}"
LATIN = "A-Za-z"

STRIP_RE = rf"^[{PY_WHITESPACE}]+|[{PY_WHITESPACE}]+\z"
SPLIT_RE = rf"[{PY_WHITESPACE}]+"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col: str | Column) -> Column:
    """Python ``str.strip()``: every Unicode whitespace character (trap T1).

    ``trim`` with an explicit character set only looks at the two ends, so
    it costs nothing on long texts (a regex would scan them whole).
    """
    return F.trim(_c(col), F.lit(PY_WHITESPACE_CHARS))


def clean_text(col: str | Column, sentinels: Sequence[str] = SENTINELS,
               casefold: bool = True) -> Column:
    """B1: strip; sentinel texts and NULL become ''."""
    stripped = py_strip(col)
    key = F.lower(stripped) if casefold else stripped
    longest = max((len(x) for x in sentinels), default=0)
    # the length test short-circuits, so long texts are never lower-cased
    is_sentinel = (F.length(stripped) <= longest) & key.isin(*sentinels) if sentinels else F.lit(False)
    return (F.when(_c(col).isNull(), F.lit(""))
            .when(is_sentinel, F.lit(""))
            .otherwise(stripped))


def clean_text_list(col: str | Column, sentinels: Sequence[str] = SENTINELS,
                    casefold: bool = True) -> Column:
    """B2: strip every part, drop empty parts, join by newline, then B1."""
    parts = F.filter(F.transform(_c(col), lambda x: py_strip(x)),
                     lambda x: x.isNotNull() & (x != ""))
    return clean_text(F.array_join(parts, "\n"), sentinels, casefold)


def merge_text_fields(df_columns: Sequence[str], fields: Sequence[str] = TEXT_FIELDS,
                      sentinels: Sequence[str] = SENTINELS, casefold: bool = True) -> Column:
    """First-seen distinct non-empty cleaned fields joined by newline.

    Fields absent from the frame are treated as NULL, so historical schema
    variants are tolerated.
    """
    present = set(df_columns)
    cleaned = [clean_text(F.col(f), sentinels, casefold) if f in present
               else F.lit("") for f in fields]
    kept = F.filter(F.array(*cleaned), lambda x: x != "")
    return F.array_join(F.array_distinct(kept), "\n")


#: fixed values: the scripts that are told apart by default, and their characters
SCRIPTS = {"Devanagari": DEVANAGARI, "Latin": LATIN}


def script_class(col: str | Column, scripts: dict[str, str] = SCRIPTS) -> Column:
    """Which of ``scripts`` (name: character class) a text uses: their names joined by
    `` + ``, a single one with `` only``, none ``Other``."""
    used = F.array_compact(F.array(*[F.when(_c(col).rlike(f"[{chars}]"), name) for name, chars in scripts.items()]))
    return (F.when(F.size(used) == 0, "Other").when(F.size(used) == 1, F.concat(used[0], F.lit(" only")))
            .otherwise(F.array_join(used, " + ")))


def contains_script(col: str | Column, char_class: str = DEVANAGARI) -> Column:
    """Any character inside the class."""
    return F.coalesce(_c(col).rlike(f"[{char_class}]"), F.lit(False))


def word_count(col: str | Column) -> Column:
    """Python ``len(text.split())``."""
    return F.size(F.filter(F.split(_c(col), SPLIT_RE), lambda x: x != "")).cast("bigint")


def char_count(col: str | Column) -> Column:
    """Code points, like Python ``len``."""
    return F.length(_c(col)).cast("bigint")


def add_prompt(col: str | Column, prompt: str) -> Column:
    """Prefix a prompt such as ``query: `` or ``passage: ``."""
    return F.concat(F.lit(prompt), _c(col))


def config_name(col: str | Column) -> Column:
    """A model id -> a stable configuration name.

    Lower-case every path part, collapse other characters to ``-``, strip
    ``-`` and ``.`` at both ends, drop empty parts and join by ``--``. An id of which
    nothing is left is an error; a null one stays null.
    """
    parts = F.split(py_strip(col), "/")
    cleaned = F.transform(
        parts,
        lambda p: F.regexp_replace(F.regexp_replace(F.lower(p), r"[^a-z0-9._-]+", "-"),
                                   r"^[-.]+|[-.]+$", ""))
    name = F.array_join(F.filter(cleaned, lambda p: p != ""), "--")
    nothing = F.raise_error(F.concat(F.lit("no configuration name is left of "), _c(col)))
    return F.when(name == "", nothing.cast("string")).otherwise(name)


@F.pandas_udf(T.StringType())
def _nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


# Python's \w is letters, numbers and '_'; combining marks are not word
# characters there, while Java's (?U)\w keeps them (trap T2).
_NON_WORD = rf"[^\p{{L}}\p{{N}}_{PY_WHITESPACE}]"


def normalize_query(col: str | Column, unicode_fold: bool = True) -> Column:
    """NFKC, casefold, non-word characters to space, squeeze, strip.

    ASCII text stays in the JVM, where ``lower`` is the same; only other text goes
    through Python. ``unicode_fold=False`` takes ``lower`` for all text.
    """
    c = _c(col)
    base = F.lower(c)
    if unicode_fold:
        ascii_only = ~c.rlike(r"[^\x00-\x7F]")
        base = F.when(ascii_only, base).otherwise(_nfkc_casefold(F.when(~ascii_only, c)))
    spaced = F.regexp_replace(base, _NON_WORD, " ")
    squeezed = F.regexp_replace(spaced, SPLIT_RE, " ")
    return py_strip(squeezed)


def column_views(views: Sequence[tuple[str, DataFrame, dict[str, str | Column]]],
                 columns: Sequence[str] = ("anchor", "positive", "negative", "score")) -> DataFrame:
    """Training views in one long table (task, columns..): each view names its task, its
    frame and where its columns come from (a column's name or an expression); columns that a
    view has not are null. Scores are doubles, all others strings."""
    kinds = {c: "double" if c == "score" else "string" for c in columns}
    out = None
    for task, df, taken in views:
        unknown = set(taken) - set(columns)
        if unknown:
            raise ValueError(f"view {task!r} gives columns that are not asked for: {sorted(unknown)}")
        part = df.select(F.lit(task).alias("task"), *[
            (_c(taken[c]) if c in taken else F.lit(None)).cast(kinds[c]).alias(c) for c in columns])
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no view is asked for")
    return out


def pad_list(values: Column, n: int) -> Column:
    """Exactly ``n`` elements: the last is repeated when there are fewer, the
    rest cut when there are more. An empty or NULL list is a data error."""
    empty = F.raise_error(F.lit("no value to pad a list with"))
    made = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.element_at(values, F.least(i, F.size(values))))
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, made).otherwise(F.array(empty.cast("string")))
