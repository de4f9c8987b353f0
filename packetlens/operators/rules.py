"""Rule that supplements the models in realtime jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The rule and what it assigns.
LARGE_FRAME = 1200
RULE_LABEL = "suspicious_traffic"
RULE_CONFIDENCE = 0.9


def flag_large_frames(df: DataFrame) -> DataFrame:
    """Flag frames above ``LARGE_FRAME`` that no model flagged; ``anomaly_score`` stays as it is."""
    if "frame_len" not in df.columns:
        return df
    hit = (F.col("frame_len") > LARGE_FRAME) & ~F.col("is_anomaly").eqNullSafe(1)
    return df.withColumns(
        {
            "is_anomaly": F.when(hit, 1).otherwise(F.col("is_anomaly")),
            "attack_type": F.when(hit, RULE_LABEL).otherwise(F.col("attack_type")),
            "attack_confidence": F.when(hit, RULE_CONFIDENCE).otherwise(F.col("attack_confidence")),
        }
    )
