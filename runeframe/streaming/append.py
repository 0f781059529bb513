"""Documents that arrive as a stream are appended to an index of suffixes, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from runeframe.operators.suffixes import index_rows


def append_stream(docs: DataFrame, path: str, checkpoint: str, key: int = 16) -> StreamingQuery:
    """Starts writing corpus and suffixes of a stream of (doc_id, text) under path. Each batch is a folder of its own, which a repeated batch replaces."""

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.select("doc_id", "text").where("text is not null")
        rows.write.mode("overwrite").parquet(f"{path}/corpus/batch={number}")
        index_rows(rows, key).sortWithinPartitions("key", "doc_id", "pos").write.mode("overwrite").parquet(f"{path}/suffixes/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
