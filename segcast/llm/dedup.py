"""Exact deduplication by skew-safe combining.

Texts are equal when they agree after lower-casing A-Z.  The work goes in three
levels, each of which groups by digest *and* full normalised content, so a
digest collision never merges two different texts:

1. every map task merges its own copies (partial aggregation);
2. the shuffle merges the copies of one digest that share a salt;
3. the winners of the salts, at most ``n_salts`` rows per text, are combined.

A group of copies that holds a third of all rows therefore reaches level 2 spread
over ``n_salts`` keys and level 3 as at most ``n_salts`` rows.  The decision goes
back to the documents over (digest, salt), which is as evenly spread.

Defined cases: a null text counts as empty; an empty table gives no rows; of
equal texts the largest doc_id stays (a null doc_id is smaller than any); of rows
repeating that doc_id one is marked kept.  ``drop_exact_copies`` returns one row per
text, found again by doc_id and digest, so documents that share a doc_id or have none
keep each of their texts.  Columns beyond doc_id and text are only carried along there
and may have any name.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segcast.llm.common import keep_rows, materialise, text_or_empty

N_SALTS = 64


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; the fast built-in serves texts that are all ASCII."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def normal_text() -> Column:
    return ascii_lower(text_or_empty().cast("string"))


def normalised(docs: DataFrame, n_salts: int = N_SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, norm, digest, salt): the normalised text, its digest, the document's salt."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal_text().alias("norm"))
    return base.select("doc_id", "norm", digest(F.col("norm")).alias("digest"),
                       F.pmod(F.xxhash64("doc_id"), F.lit(n_salts)).cast("int").alias("salt"))


def salt_winners(norm: DataFrame) -> DataFrame:
    """Levels 1 to 3: (digest, salt, keep_id, group_size, norm), one row for each salt of each text.

    ``norm`` is filled only where a digest has several texts, to tell them apart.
    """
    salted = norm.groupBy("digest", "norm", "salt").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    by_text, by_digest = Window.partitionBy("digest", "norm"), Window.partitionBy("digest")
    combined = (
        salted.repartition("digest")
        .withColumn("keep_id", F.max("top").over(by_text))
        .withColumn("group_size", F.sum("n").over(by_text))
        .withColumn("clash", F.min("norm").over(by_digest) != F.max("norm").over(by_digest))
    )
    return combined.select("digest", "salt", "keep_id", "group_size",
                           F.when(F.col("clash"), F.col("norm")).alias("norm"))


def exact_groups(docs: DataFrame, n_salts: int = N_SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, keep_id, group_size, kept."""
    winners = materialise(salt_winners(normalised(docs, n_salts, digest)), "exact-winners")
    plain, clashing = winners.filter(F.col("norm").isNull()), winners.filter(F.col("norm").isNotNull())
    full = normalised(docs, n_salts, digest)
    found = full.drop("norm").join(plain.drop("norm"), ["digest", "salt"])
    if not clashing.isEmpty():  # one digest, several texts: the content decides
        found = found.unionByName(full.join(clashing, ["digest", "salt", "norm"]).drop("norm"))
    same = Window.partitionBy("digest", "salt", "doc_id", "keep_id").orderBy("group_size")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(same) == 1)
    return found.withColumn("kept", kept).select("doc_id", "digest", "keep_id", "group_size", "kept")


def drop_exact_copies(docs: DataFrame, n_salts: int = N_SALTS) -> DataFrame:
    """The documents that stay, with the columns of ``docs``."""
    winners = salt_winners(normalised(docs, n_salts)).select(F.col("keep_id").alias("doc_id"), "digest").distinct()
    return keep_rows(docs, materialise(winners, "exact-winners"), sha256(normal_text()))
