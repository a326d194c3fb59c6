"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document gets a few integer statistics. A sketch of a statistic is a table (bucket, count): a value's
bucket keeps its leading 7 bits (as in a high-dynamic-range histogram), so a quantile is off by at most
1/64 of its value, two sketches merge by adding counts, the order of rows and merges never matters, and a
sketch has at most a few thousand buckets. There is one sketch per (lang, source) and statistic, merged
upwards into one per lang and one over all; groups with fewer than ``MIN_GROUP`` documents use the next one up.

A document is rejected when a statistic lies beyond its group's fence: third quartile plus ``REACH`` times
the interquartile range plus a fixed slack (and, for word length, the same below the first quartile).
Quartiles of a group move with its typical documents and not with its outliers, so clean documents of an
unusual source stay.

With more than a quarter of junk the third quartile lies in the junk, so a fence stops at the larger of two bounds:
one from the group's first quartile and first decile alone, which less than three quarters of junk above don't move
(``TAIL`` of their distances are the same reach in a normal distribution), and one from all documents, the smaller of
their own fence and that from the lower half of their values. The fence below word length is bounded likewise from
above. So a source with up to three quarters of junk loses it, as long as less than half of all documents,
unusual clean ones included, stand out in that statistic.

Pass 1 builds the sketches (counts are combined before the shuffle) and writes the thresholds, one row per
(lang, source). Pass 2 joins them to the documents: Spark broadcasts that table if its size on disk is below
the broadcast limit, and else splits skewed keys of a shuffled join.

Statistics: words are runs without ASCII white space, a repeated word lies in a 3-word window that the text
has twice or more, windows are compared by their 64-bit hash.

Defined results: a null or empty text has no words, fails the base rule and takes part in no sketch (as any
document that fails the base rule); null lang or source form groups of their own; repeated rows count as
often as they occur; empty input gives no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, clear_of_helpers, words, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_GROUP = 100
REACH = 4
#: Distances between first decile and first quartile from there to the fence; half of quartile ranges from the median to it.
TAIL, HALF = 12, 9
#: statistic -> (slack, fence below too); in thousandths, word length in hundredths of a character.
STATISTICS = {"word_length": (100, True), "symbol_share": (50, False), "dup_line_share": (400, False),
              "repeat_share": (300, False), "capital_share": (100, False)}
#: Up to so many different repeated windows, a text's windows are looked up in a list instead of sorted.
FEW = 32
SYMBOLS = r"[^#*$%&|<>]+"


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with __words, __chars, __symbols, __dup_lines, __repeat_words, __base_failed and the statistics as __s_<name>."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.withColumns({"__w": words(F.col(text)), "__lines": lines, "__marks": F.regexp_replace(t, r"[^#*$%&|<>A-Z!]+", "")})
    last = F.size("__w") - 3
    window = lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))
    rows = rows.withColumn("__h", F.when(last < 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window)))
    rows = rows.withColumn("__in_order", F.when(F.size(F.array_distinct("__h")) == F.size("__h"), F.array().cast("array<bigint>")).otherwise(F.sort_array("__h")))
    rows = rows.withColumn("__again", F.array_distinct(F.filter("__in_order", lambda h, i: h == F.get("__in_order", i - 1))))
    # Few repeated windows: look each window up. Many: sort windows with their places and compare neighbours.
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    placed = lambda: F.transform("__h", lambda h, p: F.struct(h.alias("h"), p.alias("p")))
    rows = rows.withColumn("__sorted", F.when(F.size("__again") > FEW, F.array_sort(placed())).otherwise(none))
    at = lambda i: F.get("__sorted", i)["h"]
    neighbours = F.filter(F.sequence(F.lit(0), F.greatest(F.size("__sorted") - 1, F.lit(0))), lambda i: (at(i) == at(i - 1)) | (at(i) == at(i + 1)))
    places = F.when(F.size("__again") > FEW, F.transform(neighbours, lambda i: F.get("__sorted", i)["p"])).otherwise(
        F.transform(F.filter(placed(), lambda x: F.array_contains("__again", x["h"])), lambda x: x["p"]))
    covered = F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2))))
    left = lambda drop: F.length(F.regexp_replace("__marks", drop, "")).cast("long")
    counts = {"__words": F.size("__w").cast("long"), "__chars": F.length(F.array_join("__w", "")).cast("long"), "__symbols": left(SYMBOLS), "__capitals": left("[^A-Z!]+"),
              "__n_lines": F.size("__lines").cast("long"),
              "__dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
              "__repeat_words": F.when(F.size("__again") == 0, F.lit(0)).otherwise(F.size(covered)).cast("long")}
    # A generator of one row: later filters on the counts stay above it, so each count is made once a row.
    rows = rows.select(*docs.columns, F.inline(F.array(F.struct(*[c.alias(k) for k, c in counts.items()]))))
    failed = (F.col("__words") < MIN_WORDS) | (100 * F.col("__repeat_words") > MAX_REPEAT_PERCENT * F.col("__words"))
    share = lambda part, whole, unit=1000: F.when(F.col(whole) > 0, F.expr(f"{unit} * {part} div {whole}")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumns({
        "__base_failed": failed,
        "__s_word_length": share("__chars", "__words", 100), "__s_symbol_share": share("__symbols", "__chars"),
        "__s_dup_line_share": share("__dup_lines", "__n_lines"), "__s_repeat_share": share("__repeat_words", "__words"),
        "__s_capital_share": share("__capitals", "__chars")})
    return rows.select(*docs.columns, "__words", "__chars", "__symbols", "__dup_lines", "__repeat_words", "__base_failed", *[f"__s_{s}" for s in STATISTICS])


def sketches(measured: DataFrame, lang: str, source: str) -> DataFrame:
    """(level, lang, source, statistic, bucket, n): level 2 per (lang, source), 1 per lang, 0 over all."""
    long = measured.select(
        F.when(F.col("__base_failed"), 0).otherwise(1).alias("one"), F.col(lang).alias("lang"), F.col(source).alias("source"),
        F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(f"__s_{s}").alias("v")) for s in STATISTICS])).alias("x"))
    drop = F.greatest(F.length(F.bin("x.v")) - 7, F.lit(0))
    long = long.select("one", "lang", "source", "x.statistic", F.col("x.v").alias("v"), drop.alias("drop"))
    bucket = F.expr("shiftleft(shiftright(v, drop), drop)")
    leaf = long.groupBy("lang", "source", "statistic", bucket.alias("bucket")).agg(F.sum("one").alias("n")).where("n > 0")
    # Merging sketches: each leaf bucket counts in its own group, in its lang's and in that of all.
    up = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), (F.col("lang") if i else F.lit(None).cast("string")).alias("lang"),
                                      (F.col("source") if i > 1 else F.lit(None).cast("string")).alias("source")) for i in range(3)]))
    merged = leaf.select("statistic", "bucket", "n", up.alias("g"))
    return merged.groupBy("g.level", "g.lang", "g.source", "statistic", "bucket").agg(F.sum("n").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source): lo_<statistic> and hi_<statistic>, of the lowest level with MIN_GROUP documents (else over all)."""
    group = ["level", "lang", "source", "statistic"]
    up_to = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sketch.withColumns({"upto": F.sum("n").over(up_to), "total": F.sum("n").over(Window.partitionBy(*group))})
    at = lambda part: F.min(F.when(100 * F.col("upto") >= part * F.col("total"), F.col("bucket")))
    fences = ranked.groupBy(*group).agg(F.max("total").alias("total"), *[at(part).alias(k) for k, part in (("p10", 10), ("q1", 25), ("q2", 50), ("q3", 75), ("p90", 90))])
    slack = F.element_at(F.create_map(*[F.lit(x) for s, (v, _) in STATISTICS.items() for x in (s, v)]), F.col("statistic"))
    p10, q1, q2, q3, p90 = map(F.col, ("p10", "q1", "q2", "q3", "p90"))
    lo, hi = q1 - REACH * (q3 - q1), q3 + REACH * (q3 - q1)
    fences = fences.withColumns({"lo": lo - slack, "hi": hi + slack, "own_lo": q3 - TAIL * (p90 - q3) - slack, "own_hi": q1 + TAIL * (q1 - p10) + slack,
                                 "half_lo": F.greatest(lo, q2 - HALF * (q3 - q2)) - slack, "half_hi": F.least(hi, q2 + HALF * (q2 - q1)) + slack})
    kinds = [f"{k}{side}" for k in ("", "own_", "half_") for side in ("lo", "hi")]
    wide = fences.groupBy("level", "lang", "source").agg(
        F.max("total").alias("total"), *[F.max(F.when(F.col("statistic") == s, F.col(k))).alias(f"{k}_{s}") for s in STATISTICS for k in kinds])
    wide = wide.select("level", F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), "total", F.struct(*[f"{k}_{s}" for s in STATISTICS for k in kinds]).alias("fence"))
    # Each group asks for its own fence, its lang's and that over all, and takes the nearest that has enough documents.
    nothing = F.lit(None).cast("string")
    ask = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), (F.col("of_lang") if i else nothing).alias("a_lang"),
                                       (F.col("of_source") if i > 1 else nothing).alias("a_source")) for i in range(3)]))
    asked = wide.where("level = 2").select(F.col("of_lang").alias("__lang"), F.col("of_source").alias("__source"), ask.alias("q")).select("__lang", "__source", "q.*")
    met = asked.join(wide, (F.col("at") == F.col("level")) & F.col("a_lang").eqNullSafe(F.col("of_lang")) & F.col("a_source").eqNullSafe(F.col("of_source")))
    met = met.where((F.col("total") >= MIN_GROUP) | (F.col("level") == 0))
    met = met.groupBy("__lang", "__source").agg(F.max_by("fence", "level").alias("near"), F.min_by("fence", "level").alias("all"))
    bounded = [x for s in STATISTICS for x in (
        F.greatest(f"near.lo_{s}", F.least(f"near.own_lo_{s}", f"all.half_lo_{s}")).alias(f"lo_{s}"),
        F.least(f"near.hi_{s}", F.greatest(f"near.own_hi_{s}", f"all.half_hi_{s}")).alias(f"hi_{s}"))]
    return met.select("__lang", "__source", F.struct(*bounded).alias("__fence"))


def judge(measured: DataFrame, table: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``measured`` with __kept; a document that passes the base rule has counted in its group's sketch, so it finds a fence."""
    joined = measured.join(table, F.col(lang).eqNullSafe(F.col("__lang")) & F.col(source).eqNullSafe(F.col("__source")), "left")
    beyond = F.lit(False)
    for s, (_, both) in STATISTICS.items():
        beyond = beyond | (F.col(f"__s_{s}") > F.col(f"__fence.hi_{s}"))
        if both:
            beyond = beyond | (F.col(f"__s_{s}") < F.col(f"__fence.lo_{s}"))
    return joined.withColumn("__kept", F.when(F.col("__base_failed"), F.lit(False)).otherwise(~F.coalesce(beyond, F.lit(False)))).drop("__lang", "__source", "__fence")


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    The statistics carry no text, so they are written once and serve both passes."""
    measured = written(with_statistics(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    got = judge(measured, written(thresholds(sketches(measured, "lang", "source"))))
    return got.select("doc_id", F.col("__words").alias("n_words"), F.col("__chars").alias("word_chars"), F.col("__symbols").alias("n_symbols"),
                      F.col("__dup_lines").alias("n_dup_lines"), F.col("__repeat_words").alias("n_repeat_words"),
                      F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


@clear_of_helpers
def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of ``docs``. The statistics are made in either pass, so that no text is shuffled."""
    measured = with_statistics(docs)
    return judge(measured, written(thresholds(sketches(measured, "lang", "source")))).where("__kept").select(*docs.columns)
