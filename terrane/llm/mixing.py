"""A mix of sources with target weights, as a schedule of equal blocks of words.

The schedule has `slots` slots. Slot i is the point i times the golden ratio, modulo one, which
fills the interval evenly at every prefix; cumulative target shares map it to a source. So any
stretch of the schedule is near the target weights, whatever its length. Slots are ranked
within their source, and rank r takes block r of the source: its documents in shuffled order,
cut into blocks of equal numbers of words, over and over. A source's last slot stops at its
target. As every turn of a source ends in a block that is not full, and a source may be smaller
than a block, the slots that it still needs for its target come after the others.

Running sums and ranks of a source that holds most rows never pass through one task: they are
taken within hashed parts of the source or stretches of slots, whose sums are added up first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.text import WORD

WEIGHTS = (3, 1, 2)  # of the sources in order, repeating
SHARE = 1.5  # words of the mix for a word of the input
REPEATS = 2.0  # a source gives at most so many times its words
SLOTS = 1 << 20
PARTS = 1024  # of a source, for its shuffled order
CELLS = 4096  # of the unit interval, to find a slot's source by an equal key
STRETCH = 4096  # slots whose ranks are counted together

# Fixed value: the golden ratio as a fraction of 2**32.
GOLDEN = 2654435769


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) from rows of (source, size).

    Sources in code point order, null last, take WEIGHTS in turn. All share SHARE times all
    words by weight; a source stops at REPEATS times its words and the others share the rest.
    So the targets are least(cap, level * weight) for the one level that uses up the total,
    found over the sources in the order in which they reach their caps.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_place") % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("_place", place).withColumn("weight", weight.cast("double")).withColumn("_cap", F.col("source_size") * REPEATS)
    by_level = Window.orderBy(F.col("_cap") / F.col("weight"), "_place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) * SHARE - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    per = per.withColumn("_level", rest / F.sum("weight").over(from_here)).withColumn("_open", F.col("_level") * F.col("weight") < F.col("_cap"))
    # The first source that its level leaves below its cap sets the level of all after it; the
    # levels of later ones, which take caps off that are not reached, are lower.
    level = F.max(F.when(F.col("_open"), F.col("_level"))).over(everything)
    target = F.when(F.max(F.col("_open").cast("int")).over(by_level) == 1, level * F.col("weight")).otherwise(F.col("_cap"))
    return per.withColumn("target", F.least(target, F.col("_cap"))).select("source", "source_size", "weight", "target")


def slots(sources: DataFrame, count: int = SLOTS) -> DataFrame:
    """(slot, source, rank): the schedule, every source's slots ranked from 0.

    A source's slots are found through the cells of the unit interval that its share overlaps.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = sources.withColumn("_sum", F.sum("target").over(all_rows)).where("_sum > 0 AND target > 0")
    share = share.withColumn("_to", F.sum("target").over(by_name) / F.col("_sum")).withColumn("_from", F.col("_to") - F.col("target") / F.col("_sum"))
    first, last = F.floor(F.greatest(F.col("_from"), F.lit(0.0)) * CELLS), F.least(F.floor(F.col("_to") * CELLS), F.lit(CELLS - 1))
    ranges = share.select("source", "_from", "_to", F.explode(F.sequence(first, F.greatest(first, last))).alias("_cell"))
    point = F.col("id") % (1 << 31) * GOLDEN % (1 << 32) / float(1 << 32)
    points = sources.sparkSession.range(count).select(F.col("id").alias("slot"), point.alias("_point"))
    points = points.withColumn("_cell", F.floor(F.col("_point") * CELLS))
    found = points.join(ranges, "_cell").where("_point >= _from AND _point < _to").select("slot", "source", F.floor(F.col("slot") / STRETCH).alias("_stretch"))
    counts = found.groupBy("source", "_stretch").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("source").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("_source"), F.col("_stretch").alias("_at"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    ranked = found.join(counts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_stretch") == F.col("_at")))
    within = F.row_number().over(Window.partitionBy("source", "_stretch").orderBy("slot"))
    return ranked.select("slot", "source", (F.col("_ahead") + within - 1).alias("rank"))


def added(sources: DataFrame, ranked: DataFrame, count: int = SLOTS) -> DataFrame:
    """(slot, source, rank): the slots that `ranked` lacks for the sources to reach their targets.

    `sources` holds (source, source_size, target, _block). A source lacks a few slots at most,
    as it takes no more than REPEATS turns.
    """
    size, block, words = F.col("source_size"), F.col("_block"), F.floor(F.col("target") + 0.5)
    turns = F.floor(words / size)
    needed = turns * F.ceil(size / block) + F.ceil((words - turns * size) / block)
    have = ranked.groupBy(F.col("source").alias("_of")).agg(F.count("*").alias("_have"))
    lack = sources.where("target > 0").join(have, F.col("source").eqNullSafe(F.col("_of")), "left")
    lack = lack.select("source", F.coalesce("_have", F.lit(0)).alias("_have"), needed.alias("_needed")).where("_needed > _have")
    # One row per source here, as in targets().
    before = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    lack = lack.withColumn("_before", F.coalesce(F.sum(F.col("_needed") - F.col("_have")).over(before), F.lit(0)))
    ranks = lack.withColumn("rank", F.explode(F.sequence(F.col("_have"), F.col("_needed") - 1)))
    return ranks.select((F.col("_before") + F.col("rank") - F.col("_have") + count).alias("slot"), "source", "rank")


def placed(rows: DataFrame, seed: int = 0) -> DataFrame:
    """`rows` (source, key, size) with `begin`, the words before each in its source's shuffled order.

    The order is by a hash of the key; `part` and `nth` name a row, repeated rows too.
    """
    rows = rows.withColumn("_hash", F.xxhash64("key", F.lit(seed))).withColumn("part", F.pmod("_hash", F.lit(PARTS)))
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("_words"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_source"), F.col("part").alias("_part"), F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_ahead"))
    joined = rows.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
    order = Window.partitionBy("source", "part").orderBy("_hash", "key", "size")
    begin = F.col("_ahead") + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return joined.withColumn("begin", begin).withColumn("nth", F.row_number().over(order)).drop("_source", "_part", "_ahead", "_hash")


def pieces(rows: DataFrame, seed: int = 0, count: int = SLOTS) -> DataFrame:
    """The mix: (slot, part, nth, key, size, source, source_size, target, from_word, words).

    Each row takes `words` words from `from_word` on of a document in its turn; documents that
    the mix leaves out have one row without a slot. `rows` holds (source, key, size).
    """
    sources = targets(rows)
    words = F.sum(F.col("target")).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sources = sources.withColumn("_block", F.greatest(F.ceil(words / count), F.lit(1)))
    about = sources.withColumnRenamed("source", "_of")
    same = F.col("source").eqNullSafe(F.col("_of"))
    documents = placed(rows, seed).join(about, same).drop("_of")
    last = F.floor((F.col("begin") + F.col("size") - 1) / F.col("_block"))
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("begin") / F.col("_block")), last))
    documents = documents.withColumn("block", F.explode_outer(blocks))

    ranked = slots(sources, count)
    turn = ranked.unionByName(added(sources, ranked, count)).join(about, same).drop("_of")
    per_source = F.ceil(F.col("source_size") / F.col("_block"))
    turn = turn.withColumn("_pass", F.floor(F.col("rank") / per_source)).withColumn("_turn", F.col("rank") % per_source)
    left = F.floor(F.col("target") + 0.5) - F.col("_pass") * F.col("source_size") - F.col("_turn") * F.col("_block")
    turn = turn.withColumn("_left", left).where("_left > 0").select("slot", F.col("source").alias("_of"), "_turn", "_left")

    both = documents.join(turn, same & (F.col("block") == F.col("_turn")), "left")
    at = F.col("block") * F.col("_block")
    low = F.greatest(F.col("begin"), at)
    high = F.least(F.col("begin") + F.col("size"), at + F.least(F.col("_block"), F.coalesce(F.col("_left"), F.lit(0))))
    both = both.withColumn("words", F.coalesce(F.greatest(high - low, F.lit(0)), F.lit(0)).cast("long")).withColumn("from_word", low - F.col("begin"))
    return both.select("slot", "part", "nth", "key", "size", "source", "source_size", "target", "from_word", "words")


def mix(docs: DataFrame, key: str = "doc_id", seed: int = 0, count: int = SLOTS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) per row of `docs`.

    `taken` counts words, repeats included, and is at most REPEATS times `size`. Null texts have
    size 0 and are never taken; null sources are one source; a missing id is an id like others.
    Repeated rows each take their own turn. Without any words all targets are 0. An empty table
    gives an empty one. The schedule depends on ids and sizes alone, so reruns agree.
    """
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col(key).cast("string").alias("key"), word_count(F.col("text")).alias("size"))
    whole = pieces(rows, seed, count).groupBy("source", "part", "nth", "key", "size", "source_size", "target").agg(F.sum("words").alias("taken"))
    return whole.select(F.col("key").cast(docs.schema[key].dataType).alias(key), "source", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, key: str = "doc_id", seed: int = 0, count: int = SLOTS) -> DataFrame:
    """`docs` as the mix takes them: a row for each started turn of a document.

    A document is kept whole where the mix stops within it, at most one in each source. Rows that
    share an id are taken alike, each as often as the most often taken of them.
    """
    turns = F.ceil(F.col("taken") / F.col("size")).cast("int")
    often = mix(docs, key, seed, count).where("taken > 0").groupBy(key).agg(F.max(turns).alias("_turns"))
    often = often.select(F.col(key).alias("_key"), "_turns")
    # The row travels as one struct, so that its column names meet no others.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("_own"), word_count(F.col("text")).alias("_size"))
    joined = rows.join(often, F.col("_own").eqNullSafe(F.col("_key"))).where("_size > 0")
    return joined.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_turns")))).select("row.*")
