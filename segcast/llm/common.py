"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segcast.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark (the folder may be in a store only Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    """The text with null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage at a table every executor can read, so later stages
    neither recompute it nor depend on an executor that may be lost.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, keep: DataFrame, digest: Column) -> DataFrame:
    """Rows of ``docs`` whose doc_id and ``digest`` (of the text) are in ``keep`` (doc_id, digest; null matches null), one row for each.

    Of rows repeating both, the one with the smallest text hash stays; each map task merges its own
    first, so a repeated row does not pile up, and null or repeated ids are spread by their texts.
    Columns are those of ``docs``.  Aggregate and join share one shuffle of the texts.
    """
    key = value, missing, mark = [free_name(docs, n) for n in ("id_value", "id_missing", "id_digest")]
    row = free_name(docs, "id_row")

    def keyed(doc_id: Column, text: Column) -> list[Column]:
        return [F.coalesce(doc_id, F.lit(0)).alias(value), F.isnull(doc_id).alias(missing), text.alias(mark)]

    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    smallest = F.struct(F.xxhash64("text"), F.length("text"))
    rows = docs.groupBy(*keyed(F.col("doc_id").cast("long"), digest)).agg(F.min_by(whole, smallest).alias(row))
    kept = rows.join(keep.select(*keyed(F.col("doc_id"), F.col("digest"))), key, "left_semi")
    return kept.select(*[F.col(f"`{row}`.`{c}`").alias(c) for c in docs.columns])


def map_texts(df: DataFrame, run, schema, batch_bytes: int = 4 << 20) -> DataFrame:
    """``mapInArrow`` over rows with texts, in batches of about ``batch_bytes``.

    The default batch of 10,000 rows may hold any amount of text; the byte bound
    keeps a task's memory the same for short and long documents.  A bound the
    caller has set on the session is left as it is.
    """
    conf, key, own = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch", "segcast.llm.batchBytes"
    if conf.get(key, None) in (None, conf.get(own, None)):
        conf.set(key, str(batch_bytes))
        conf.set(own, str(batch_bytes))
    return df.mapInArrow(run, schema)
