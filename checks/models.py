"""Fixed models for checks: a two-tree forest and a classifier that SQL can restate."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.operators.iforest import IsolationForestModel
from packetlens.sources.schemas import PACKET_FEATURES

# Tree, node, feature, threshold, left, right, rows, depth.
FROZEN_NODES = [
    (0, 0, "frame_len", 1000.0, 1, 2, 256, 0),
    (0, 1, None, None, None, None, 200, 1),
    (0, 2, "hour_of_day", 6.0, 3, 4, 56, 1),
    (0, 3, None, None, None, None, 6, 2),
    (0, 4, None, None, None, None, 50, 2),
    (1, 0, "is_tcp", 0.5, 1, 2, 256, 0),
    (1, 1, None, None, None, None, 56, 1),
    (1, 2, None, None, None, None, 200, 1),
]
FROZEN_OFFSET = -0.55


def frozen_forest() -> IsolationForestModel:
    names = ["tree", "node", "feature", "threshold", "left", "right", "n", "depth"]
    nodes = pd.DataFrame(FROZEN_NODES, columns=names).astype({"left": "Int32", "right": "Int32"})
    return IsolationForestModel(nodes, list(PACKET_FEATURES), 256, FROZEN_OFFSET)


class FlagClassifier:
    """Labels by the SYN bit, with a two-digit confidence taken from the packet's time."""

    features = list(PACKET_FEATURES)

    def classify(self, df: DataFrame, features: Sequence[str]) -> DataFrame:
        label = F.when(F.col("tcp_flag_syn") == 1, "port_scan").otherwise("ddos")
        confidence = (F.col("event_us") % 101).cast("double") / 100
        return df.withColumns({"_label": label, "_confidence": confidence})
