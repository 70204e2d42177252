"""The scoring job on micro-batches."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from inkprint.operators.explain import TreeTable, is_tree_model
from inkprint.operators.score import score_snippets


def score_stream(
    snippets: DataFrame, model: PipelineModel, out: str, checkpoint: str, top_k: int = 6
) -> StreamingQuery:
    """Score every arriving (id, code) row into Parquet.

    A batch is written under its own number, so a batch replayed after a failure replaces
    itself instead of appearing twice.
    """
    trees = TreeTable(model, snippets.sparkSession) if is_tree_model(model) else None

    def write(batch: DataFrame, number: int) -> None:
        scored = score_snippets(batch, model, top_k, trees)
        scored.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        snippets.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
