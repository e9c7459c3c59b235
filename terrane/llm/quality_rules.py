"""Quality rules whose limits follow each language and source.

Every text is measured in whole. For each (language, source) the measures are summarised by
quantile sketches; sketches merge, so a language's and the corpus's are merged from those of
its groups. A limit is the upper quartile plus `REACH` times the distance from the median to it,
so a group's own habits set what is odd in it. Only where the two are equal, as for a rate that
is zero in three documents of four, the distance in `MEASURES` is added instead. A group's limit
is its own with weight n / (n + `POOLED`) and otherwise its language's, which is pooled with the
corpus's in the same way, so limits move smoothly with the number of documents.
A text is kept if it fails none of the fixed base rules and no measure is beyond its limit.

All steps are column functions; the texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.text import GAP, WORD
from terrane.session import Workspace

# The base rules.
LEAST_WORDS = 10
REPEATED_PERCENT = 20
RUN = 5

REACH = 40.0  # wide: what is rare but ordinary stays within
POOLED = 10  # documents of a group at which its own limits weigh as much as the larger one's
SKETCH_SIZE = 400

# The rates that get adaptive limits, each with its distance from the quartile where a group shows no spread.
MEASURES = {
    "symbol_rate": 0.02,  # symbols per character of the words
    "line_rate": 0.5,  # repeated lines per line
    "repeat_rate": 0.2,  # words in repeated runs per word
    "word_length": 4.0,
    "same_word_rate": 0.25,  # words equal to the one before, per word
    "capital_rate": 0.3,  # ASCII capitals per character of the words
    "bar_rate": 0.1,  # words that hold a bar, per word
}


def measured(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """`columns`, the base counts and the rates of MEASURES. A null text is empty; rates of nothing are 0."""
    text = F.col("_text")
    rows = docs.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    w = F.col("_words")
    run = lambda i: F.xxhash64(*[w[i + k] for k in range(RUN)])
    starts = F.when(F.size(w) > RUN, F.transform(F.sequence(F.lit(0), F.size(w) - RUN), run)).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    rows = rows.withColumn("_runs", starts).withColumn("_lines", lines)
    rows = rows.withColumn("_some", F.size(F.array_distinct("_runs")) < F.size("_runs"))
    # Only where two runs hash alike: runs spelt out with their places, sorted, so equal ones meet.
    spelt = F.transform(F.sequence(F.lit(0), F.size(w) - RUN), lambda i: F.struct(F.array(*[w[i + k] for k in range(RUN)]).alias("run"), i.alias("at")))
    rows = rows.withColumn("_sorted", F.when(F.col("_some"), F.sort_array(spelt)))
    s = F.col("_sorted")
    twice = F.transform(
        F.filter(
            F.transform(s, lambda x, i: F.struct(x["at"].alias("at"), ((F.get(s, i - 1)["run"] == x["run"]) | (F.get(s, i + 1)["run"] == x["run"])).alias("twice"))),
            lambda x: F.coalesce(x["twice"], F.lit(False)),
        ),
        lambda x: x["at"],
    )
    rows = rows.withColumn("_at", F.sort_array(twice))
    at = F.col("_at")
    # A run covers its words up to the next repeated run's start.
    covered = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda a, x: F.struct((a["n"] + x + RUN - F.greatest(a["to"], x)).alias("n"), (x + RUN).alias("to")), lambda a: a["n"])
    solid = F.regexp_replace(text, GAP, "")
    rate = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    n = F.size(w)
    counted = rows.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(solid).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(F.when(F.size(at) > 0, covered), F.lit(0)).cast("long"),
            "_bars": F.size(F.filter(w, lambda x: F.contains(x, F.lit("|")))),
            # Each side of a repeated word's gap is the same: what follows is matched ahead, not taken.
            "_same": F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)(?=[\x20\x09-\x0D]+\1(?![^\x20\x09-\x0D]))")),
            "_capitals": F.regexp_count(text, F.lit("[A-Z]")),
        }
    )
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rates = {
        "symbol_rate": rate(F.col("n_symbols"), F.col("word_chars")),
        "line_rate": rate(F.col("n_dup_lines"), F.size("_lines")),
        "repeat_rate": rate(F.col("n_repeat_words"), F.col("n_words")),
        "word_length": rate(F.col("word_chars"), F.col("n_words")),
        "same_word_rate": rate(F.col("_same"), F.col("n_words")),
        "capital_rate": rate(F.col("_capitals"), F.col("word_chars")),
        "bar_rate": rate(F.col("_bars"), F.col("n_words")),
    }
    return counted.select(*columns, *counts, *[rates[m].cast("double").alias(m) for m in MEASURES])


def limits(rows: DataFrame, pooled: int = POOLED) -> DataFrame:
    """(lang, source, n and one limit per measure) for every pair that occurs; nulls are a value."""
    sketch = {m: F.kll_sketch_agg_double(m, F.lit(SKETCH_SIZE)) for m in MEASURES}
    own = rows.groupBy("lang", "source").agg(F.count("*").alias("n"), *[v.alias(m) for m, v in sketch.items()])
    # A row per group from here on; larger groups are merged from their sketches.
    by_lang = own.groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("_n_lang"), *[F.kll_merge_agg_double(m).alias(f"_lang_{m}") for m in MEASURES])
    corpus = own.agg(*[F.kll_merge_agg_double(m).alias(m) for m in MEASURES])
    joined = own.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")))
    for m in MEASURES:
        joined = joined.withColumn(f"_all_{m}", corpus.select(m).scalar())

    def alone(sketch: str, m: str) -> Column:
        middle, upper = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.5, 0.75))
        return upper + F.when(upper > middle, (upper - middle) * REACH).otherwise(F.lit(MEASURES[m]))

    def blend(n: str, own: Column, larger: Column) -> Column:
        return (F.col(n) * own + F.lit(pooled) * larger) / (F.col(n) + F.lit(pooled))

    def limit(m: str) -> Column:
        return blend("n", alone(m, m), blend("_n_lang", alone(f"_lang_{m}", m), alone(f"_all_{m}", m)))

    return joined.select("lang", "source", "n", *[limit(m).alias(f"most_{m}") for m in MEASURES])


def judged(docs: DataFrame, ws: Workspace, pooled: int = POOLED) -> DataFrame:
    """doc_id, lang, source, the base counts, base_failed, the rates, their limits, and kept.

    One row per row of `docs`, repeated rows included. Null languages and sources are groups of
    their own. An empty table gives an empty one.
    """
    rows = ws.save(measured(docs), "measured")
    most = limits(rows, pooled).withColumnRenamed("lang", "_lang").withColumnRenamed("source", "_source")
    found = rows.join(most, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED_PERCENT)
    within = F.lit(True)
    for m in MEASURES:
        within = within & (F.col(m) <= F.col(f"most_{m}"))
    found = found.withColumn("base_failed", failed).withColumn("kept", ~failed & within)
    return found.drop("_lang", "_source", "n")
