"""Expressions on labels and anomaly flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import snake, strip

# Texts that count as "anomalous" once stripped and lower-cased.
TRUE_WORDS = ["1", "true", "t", "yes", "y", "anomaly", "anomalous"]

NORMAL = "normal"


def flow_label(c: Column) -> Column:
    """Snake-case label; ``benign`` is called ``normal``."""
    label = snake(c.cast("string"))
    return F.when(label == "benign", NORMAL).otherwise(label)


def anomaly_flag(c: Column, dtype: T.DataType) -> Column:
    """INT 0/1 from a boolean, numeric or text flag; ``dtype`` is the column's type."""
    if isinstance(dtype, T.BooleanType):
        flag = F.coalesce(c, F.lit(False))
    elif isinstance(dtype, T.NumericType):
        number = c.cast("double")
        flag = F.coalesce(~F.isnan(number) & (number != 0), F.lit(False))
    else:
        flag = F.coalesce(F.lower(strip(c.cast("string"))).isin(TRUE_WORDS), F.lit(False))
    return flag.cast("int")


def attack_label(attack_type: Column, confidence: Column) -> Column:
    """Text of a live event line."""
    named = (attack_type != "") & (F.lower(attack_type) != NORMAL)
    detected = F.format_string("[ANOMALY] %s detected (confidence: %.2f)", attack_type, confidence)
    return F.when(named, detected).otherwise("[ANOMALY] Anomaly detected")
