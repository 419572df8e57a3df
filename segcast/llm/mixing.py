"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1], linear with a
slope of its own.  Its integral, scaled to the source's target, is the source's
cumulative token demand D(t).  The documents of a source stand in a fixed hashed
order; the words before a document are the demand at which it is due, so
inverting D gives its training position.  Sorting all documents by position
range-partitions the mix into training order.

Targets: sources by code point, null last, take the weights in turn; together
they share ``mix_share`` of all words.  A target stops at ``max_repeats`` times its
source; the excess is shared again by weight until none is above.  That fixed
point is min(limit, weight * level), and the level follows from running sums over
the sources sorted by limit / weight.

A source's documents are taken in order, again from the start in the next round,
until its target is used up; the one document on the border gives its leading words.
No document is taken more than ``max_repeats`` times.

Skew: the running sums inside a source are split by a hash prefix.  Sums per
(source, prefix) give each prefix its offset, and rows are summed within their
prefix, so a source with a third of all rows is spread over 16 ** ``hash_digits``
keys.  Only the table of sources, one row each, is ever in one task.

Defined cases: a null text or one of white space has size 0 and is taken 0 times;
a null source is a source of its own; an empty table gives no rows.  In the plan,
repeated rows are documents of their own, in any order among themselves; in the
mix every row has its own places, whatever rows share its doc_id or have none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segcast.llm.common import free_name, materialise, text_or_empty

WEIGHTS = (3, 1, 2)
MIX_SHARE = 1.5
MAX_REPEATS = 2
SLOPES = (-0.8, 0.0, 0.8)
HASH_DIGITS = 2
#: Words are runs of anything but \\x20 and \\x09-\\x0D.
WORD = "[^\\x20\\x09-\\x0D]+"
WORD_END = "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, mix_share: float = MIX_SHARE,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target, slope_no) from (source, size) rows."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = ((F.row_number().over(order) - 1) % len(weights)).cast("int")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = (
        totals.withColumn("turn", turn)
        .withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), F.col("turn") + 1))
        .withColumn("limit", F.col("source_size") * max_repeats)
        .withColumn("ratio", F.col("limit") / F.col("weight"))
    )
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(mix_share)
             - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # the level rises while sources under their limit-to-weight ratio are taken out and falls after: its top is the fixed point
    top = F.max("level").over(everything)
    target = F.least(F.col("limit").cast("double"), F.col("weight") * top)
    return shares.withColumn("level", level).withColumn("target", target).select("source", "source_size", "target", "turn")


def demand_position(words: Column, target: Column, slope: Column) -> Column:
    """Training time t at which the demand target * (t + slope * (t * t - t)) reaches ``words``."""
    share = F.least(F.try_divide(words, target), F.lit(1.0))
    b = 1.0 - slope
    bent = 2 * share / (b + F.sqrt(b * b + 4 * slope * share))  # stable root, also for slope 0
    return F.when(share <= 0, F.lit(0.0)).otherwise(F.least(bent, F.lit(1.0)))


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, mix_share: float = MIX_SHARE,
             max_repeats: int = MAX_REPEATS, slopes: Sequence[float] = SLOPES,
             hash_digits: int = HASH_DIGITS, row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, rounds, taken, and its column ``row`` if named.

    ``rounds`` holds (round, words, position) for each time the document is taken.  With ``row`` rows that
    repeat a doc_id stand in the order of their texts' hashes, so that reruns agree on each.
    """
    own = [] if row is None else [F.col(row)]
    tie = F.lit(0) if row is None else F.xxhash64("text")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       word_count(text_or_empty().cast("string")).alias("size"), tie.alias("tie"), *own)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    base = materialise(base.withColumn("key", key).withColumn("part", F.substring("key", 1, hash_digits)), "mix-sizes")

    targets = source_targets(base, weights, mix_share, max_repeats)
    in_source = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = base.groupBy("source", "part").agg(F.sum("size").alias("n"))
    parts = parts.withColumn("offset", F.coalesce(F.sum("n").over(in_source), F.lit(0))).withColumnsRenamed(
        {"source": "p_source", "part": "p_part"})
    parts = parts.join(targets, F.col("p_source").eqNullSafe(F.col("source"))).drop("source", "n")
    parts = materialise(parts, "mix-parts")

    in_part = Window.partitionBy("source", "part").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("before", F.coalesce(F.sum("size").over(in_part), F.lit(0)))
    placed = placed.join(parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part")))
    placed = placed.withColumn("start", F.col("before") + F.col("offset"))
    slope = F.element_at(F.array(*[F.lit(float(s)) for s in slopes]), F.col("turn") % len(slopes) + 1)

    def one_round(r: Column) -> Column:
        due = r * F.col("source_size") + F.col("start")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("target")) - due)).cast("long")
        return F.struct(r.alias("round"), words.alias("words"),
                        demand_position(due.cast("double"), F.col("target"), slope).alias("position"))

    rounds = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), one_round), lambda x: x["words"] > 0)
    taken = F.aggregate("rounds", F.lit(0).cast("long"), lambda acc, x: acc + x["words"])
    return placed.withColumn("rounds", rounds).withColumn("taken", taken).select(
        "doc_id", "source", "size", "source_size", "target", "rounds", "taken", *own)


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mix in training order: every document as often as it is taken, with the columns of ``docs``.

    A document on the border of its source's target is cut after its last word
    taken, and n_chars follows where ``docs`` has it.  Rows are range-partitioned and
    sorted by training position.
    """
    row, size, turn = (free_name(docs, n) for n in ("mix_row", "mix_size", "mix_round"))
    # the rows are numbered and written, so a place belongs to one row whatever doc_ids repeat or are missing
    docs_rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    plan = mix_plan(docs_rows, row=row, **parameters).filter("taken > 0")
    met = docs_rows.join(plan.select(row, F.col("size").alias(size), F.explode("rounds").alias(turn)), row)
    words, cut = F.col(f"{turn}.words"), F.col(f"{turn}.words") < F.col(size)
    leading = F.array_join(F.slice(F.split("text", WORD_END), F.lit(1), words.cast("int")), "")
    out = met.withColumn("text", F.when(cut, leading).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")))
    order = [F.col(f"{turn}.position"), F.xxhash64("doc_id", "text"), F.col(f"{turn}.round")]
    out = out.repartitionByRange(*order).sortWithinPartitions(*order)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
