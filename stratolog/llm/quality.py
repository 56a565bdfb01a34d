"""Quality rules: a threshold table compiled into one projection of built-in functions.

Null or empty text counts as no words. Rows are judged alone, so equal rows get equal verdicts, and an
empty table gives an empty one. Only the named id and text columns are read; others pass through
quality_filter untouched. Words are runs of anything but ASCII white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratolog.llm.shared import made_apart, set_aside

#: Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as with by on are be this was from or an at not have but "
    "der die das und in zu den von ist mit sich des auf für im dem nicht ein eine als auch es an er "
    "le la les de des du et un une en que qui dans pour par sur au est pas ce il elle avec ne se "
    "el los las del y que en un una por con para su al se es lo como no"
).split()

#: (statistic, smallest, largest): a text is kept if every statistic lies within its bounds.
THRESHOLDS = (
    ("n_words", 50, None),
    ("repeat_share", None, 0.5),
    ("mean_word_chars", 3.0, 10.0),
    ("symbol_ratio", None, 0.1),
    ("stop_words", 2, None),
    ("ended_line_share", 0.6, None),
    ("dup_line_share", None, 0.3),
)
#: Of those, the ones that base_failed stands for.
BASE = ("n_words", "repeat_share")

_SPACE = "[\\x20\\x09-\\x0D]+"
_LOW = (1 << 31) - 1


def _repeat_candidates(df: DataFrame) -> DataFrame:
    """Positions of 3-word windows whose 33-bit hash occurs twice in the row: all repeats, few others.

    Hash and position share a long, so one primitive sort brings equal hashes together.
    """
    w = F.col("_words")
    codes = F.when(
        F.size(w) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~_LOW)).bitwiseOR(i.cast("long")),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    s, high = F.col("_codes"), lambda x: F.shiftright(x, 31)
    like = lambda x, k: F.coalesce(high(F.get(s, k)) == high(x), F.lit(False))
    repeated = F.filter(s, lambda x, k: like(x, k - 1) | like(x, k + 1))
    return df.withColumn("_codes", F.sort_array(codes)).withColumn("_at", repeated).drop("_codes")


def _repeat_words(df: DataFrame) -> DataFrame:
    """n_repeat_words: words in 3-word windows that occur twice or more in the row, confirmed on the words."""
    w, g = F.col("_words"), F.col("_grams")
    gram = lambda x: (lambda p: F.struct(F.get(w, p).alias("a"), F.get(w, p + 1).alias("b"), F.get(w, p + 2).alias("c"), p.alias("p")))(x.bitwiseAND(F.lit(_LOW)).cast("int"))
    text = lambda x: F.struct(x["a"], x["b"], x["c"])
    same = lambda x, k: F.coalesce(text(F.get(g, k - 1)) == text(x), F.lit(False)) | F.coalesce(text(F.get(g, k + 1)) == text(x), F.lit(False))
    df = df.withColumn("_grams", F.sort_array(F.transform("_at", gram)))
    df = df.withColumn("_at", F.sort_array(F.transform(F.filter(g, same), lambda x: x["p"])))
    at = F.col("_at")
    steps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))).cast("long"))
    return df.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0).cast("long"), lambda x, y: x + y)).drop("_grams", "_at")


def quality_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the statistics of the threshold table and the counts behind them."""
    t = F.coalesce(F.col(text), F.lit(""))
    w, lines = F.col("_words"), F.col("_lines")
    df = docs.withColumn("_words", F.array_remove(F.split(t, _SPACE), "")).withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    df = _repeat_words(_repeat_candidates(df))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    df = df.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "stop_words": F.size(F.array_intersect(w, F.lit(STOP_WORDS))).cast("long"),
            "n_ended_lines": F.size(F.filter(lines, lambda x: x.rlike("[.!?][\\x20\\x09-\\x0D]*$"))).cast("long"),
        }
    ).drop("_words", "_lines")
    n = F.col("n_words")
    return df.withColumns(
        {
            "mean_word_chars": share(F.col("word_chars"), n),
            "symbol_ratio": share(F.col("n_symbols"), n),
            "repeat_share": share(F.col("n_repeat_words"), n),
            "ended_line_share": share(F.col("n_ended_lines"), F.col("n_lines")),
            "dup_line_share": share(F.col("n_dup_lines"), F.col("n_lines")),
        }
    )


#: Columns that quality_stats makes.
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "stop_words", "n_ended_lines", "mean_word_chars", "symbol_ratio", "repeat_share", "ended_line_share", "dup_line_share")


def _fails(rules) -> Column:
    out = F.lit(False)
    for name, low, high in rules:
        if low is not None:
            out = out | (F.col(name) < low)
        if high is not None:
            out = out | (F.col(name) > high)
    return out


def quality_verdict(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """docs with statistics, base_failed and kept; a column that has the name of one of these gives way to it.

    kept holds a row number, which is always true: the optimizer doesn't move a filter on it below the
    projections, where it would write each statistic out again and again in the condition.
    """

    def make(inner: DataFrame) -> DataFrame:
        out = quality_stats(inner, text).withColumn("base_failed", _fails([r for r in thresholds if r[0] in BASE]))
        return out.withColumn("kept", ~_fails(thresholds) & (F.monotonically_increasing_id() >= 0))

    return made_apart(docs, (text,), (*STATS, "base_failed", "kept"), make)


def quality_filter(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The rows of docs whose text passes the table, with their own columns only."""
    inner, names = set_aside(docs, text)
    out = quality_verdict(inner, text, thresholds).filter("kept")
    return out.select(*names).toDF(*docs.columns)


def query(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.schema("doc_id long, text string").parquet(f"{sf}/documents.parquet")
    return quality_verdict(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOPS = ",".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text,'') t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t,'[ \t\n\x0B\f\r]+'), lambda x: x<>'') ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x,'[^ \t\n\x0B\f\r]')) ls FROM d),
p AS (SELECT doc_id, unnest(range(len(ws)-2)) i, ws FROM w WHERE len(ws)>=3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i+1], ws[i+2], ws[i+3]) n FROM p),
r AS (SELECT doc_id, count(DISTINCT j) n_rep FROM (SELECT doc_id, unnest([i,i+1,i+2]) j FROM g WHERE n>1) GROUP BY doc_id),
s AS (SELECT w.doc_id, CAST(len(ws) AS bigint) n_words, CAST(length(array_to_string(ws,'')) AS bigint) word_chars,
  CAST(length(regexp_replace(t,'[^#*$%&|<>]','','g')) AS bigint) n_symbols, CAST(len(ls) AS bigint) n_lines,
  CAST(len(ls)-len(list_distinct(ls)) AS bigint) n_dup_lines, coalesce(r.n_rep,0) n_repeat_words,
  len(list_filter([{_STOPS}], lambda x: list_contains(ws, x))) stop_words,
  len(list_filter(ls, lambda x: regexp_matches(x,'[.!?][ \t\n\x0B\f\r]*$'))) n_ended FROM w LEFT JOIN r USING (doc_id)),
v AS (SELECT *, n_words<50 OR 100*n_repeat_words>50*n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 (NOT base_failed AND word_chars>=3*n_words AND word_chars<=10*n_words AND n_symbols/n_words<=0.1 AND stop_words>=2
  AND n_ended/n_lines>=0.6 AND n_dup_lines/n_lines<=0.3) AS kept FROM v"""
