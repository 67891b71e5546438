"""Incremental ingestion of documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from corpusloom.operators.blocks import build_chunks, ingest_summary
from corpusloom.sources.snapshots import Snapshot
from corpusloom.sources.tables import append_chunks


def stream_ingest(
    documents: DataFrame,
    to_blocks: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    key: str = "doc_id",
    filename: str | None = None,
    order: Sequence[str] = (),
    name: str | None = None,
    compact_after: int = 8,
) -> StreamingQuery:
    """New documents to chunk rows and status rows, as they arrive.

    ``documents`` is a stream with an explicit schema.  ``to_blocks`` adds ``blocks``, ``page_count``,
    ``has_content`` and, for documents that could not be parsed, ``error``.  Of the rows of a batch with
    one key, only the newest by ``order`` (without it: the largest by all other columns) is taken; with
    ``name``, also of the rows with one file name.  The rows taken are written before anything is made
    of them.  Chunks and status of a batch are one change of a snapshot: they replace what is stored
    under its keys and its file names, a batch delivered twice is known, and ``compact_after`` open
    changes are folded into the buckets they touch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store = Snapshot(batch.sparkSession, target, key)
        change = store.begin("ingest", batch_id)
        if change is not None:
            taken = change.stage(one_row_each(one_row_each(batch, key, order), name, order))
            parsed = to_blocks(taken)
            error = F.col("error") if "error" in parsed.columns else F.lit(None).cast("string")
            good = parsed.filter(error.isNull())
            chunks = append_chunks(build_chunks(good, key, filename), key).withColumnRenamed("document_id", key)
            stored = change.put("chunks", chunks)
            status = ingest_summary(parsed, stored, key)
            keys = [taken.select(key)]
            if name:
                status = status.join(taken.select(key, F.col(name).alias("_name")), key)
                if "status" in change.state["base"]:
                    names = taken.select(F.col(name).alias("_name")).filter(F.col("_name").isNotNull())
                    keys.append(store.table("status").join(names, "_name", "left_semi").select(key))
            change.put("status", status)
            change.commit(keys)
        store.compact(compact_after)

    return (
        documents.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def one_row_each(rows: DataFrame, key: str | None, order: Sequence[str]) -> DataFrame:
    """The newest row of each key, by ``order`` or else by all other columns; rows without a key stay."""
    if key is None:
        return rows
    rest = [c for c in rows.columns if c != key]
    newest = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*(order or rest), *rest)).alias("_m"))
    return newest.select(key, "_m.*").select(*rows.columns).unionByName(rows.filter(F.col(key).isNull()))


def read_ingested(spark: SparkSession, target: str, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(chunks, status) with the newest delivery of every document and, if recorded, of every file name."""
    store = Snapshot(spark, target, key)
    return store.table("chunks"), store.table("status").drop("_name")
