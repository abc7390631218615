"""An extension: a stream of new invoices, each micro-batch checked against the records and logged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.scratch import scope, written
from ..sources.store import Store


def check_stream(new: DataFrame, store: Store, checkpoint: str, source: str = "stream", add_ok: bool = False, **trigger) -> StreamingQuery:
    """Start checking a streaming DataFrame of invoices. A batch that a failure repeats is logged once: its number is
    part of the log's source, and a batch already logged is passed over; its log and its new records are one state. add_ok makes invoices found OK records."""

    def batch(rows: DataFrame, number: int) -> None:
        name = f"{source} #{number}"
        if store.table("receipt_checks").where(F.col("source") == F.lit(name)).head(1) or not rows.head(1):
            return
        with scope(rows.sparkSession):
            results = written(store.check(rows)[0], "checked")
            store.log_batch(results, name, results.where("verdict = 'OK'") if add_ok else None, source)

    return new.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
