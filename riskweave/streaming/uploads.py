"""Score transaction uploads as they arrive in a folder.

The reference processes one uploaded file at a time: map columns, clean,
derive rule features over that upload, score, flag. Here every micro-batch is
one such upload: ``readStream`` picks up new files, ``foreachBatch`` runs the
same batch plan on them, and each batch is written to its own
``batch_id=<n>`` partition with overwrite, so a retried batch replaces its own
output (exactly-once under the streaming checkpoint).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from riskweave.config import DEFAULT_CONFIG, RiskConfig


def score_uploads(spark: SparkSession, source_dir: str, schema: str, out_dir: str, checkpoint_location: str,
                  model_path: str | None = None, cfg: RiskConfig = DEFAULT_CONFIG, fmt: str = "parquet",
                  policy: str = "native", available_now: bool = True, map_columns: bool = False) -> StreamingQuery:
    """Start the stream; with ``available_now`` it processes what is there and stops."""
    from riskweave.operators.alerts import attach_scores
    from riskweave.operators.clean import clean
    from riskweave.operators.features import engineer_features
    from riskweave.plans.scoring import score_transactions, surrogate_native_score
    from riskweave.sources.mapping import apply_mapping, resolve_mapping

    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    stream = reader.load(source_dir)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        if map_columns:
            batch = apply_mapping(batch, resolve_mapping(batch.columns))
        feats = engineer_features(clean(batch), cfg)
        if model_path:
            scored, _ = score_transactions(spark, model_path, feats, policy, contamination=cfg.contamination)
        else:
            scored, _ = attach_scores(feats, surrogate_native_score(), None, cfg.contamination)
        (scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
               .parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}"))

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
