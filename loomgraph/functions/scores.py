"""Confidence arithmetic. Operand order is fixed, so that sums round alike everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = 0.75


def level(confidence: Column) -> Column:
    """verified from .99, high from .90, medium from .70, low from .50, else uncertain."""
    return (
        F.when(confidence >= 0.99, "verified").when(confidence >= 0.90, "high").when(confidence >= 0.70, "medium")
        .when(confidence >= 0.50, "low").otherwise("uncertain")
    )


def boosted(n: Column) -> Column:
    """Confidence of an entity mentioned n times: .85, .90, .95, and 1 from four on."""
    return F.least(F.lit(1.0), F.lit(0.8) + F.least(F.lit(0.2), F.lit(0.05) * n))


def evidence(s_label: Column, o_label: Column, s_pos: Column, o_pos: Column) -> Column:
    """By the distance of the labels' first places in the document; 0 stands for absent."""
    far = F.abs(s_pos - o_pos)
    return (
        F.when((s_label == "") | (o_label == ""), 0.5)
        .when((s_pos > 0) & (o_pos > 0), F.when(far < 50, 1.0).when(far < 200, 0.8).otherwise(0.6))
        .otherwise(0.3)
    )


def neural(s_conf: Column, o_conf: Column, ev: Column, base: float = BASE) -> Column:
    return F.least(F.lit(1.0), F.lit(base) * 0.5 + ((s_conf + o_conf) / 2) * 0.3 + ev * 0.2)


def hybrid(confidence: Column) -> Column:
    """Neural confidence with full symbolic agreement."""
    return F.least(F.lit(1.0), F.lit(0.7) * confidence + F.lit(0.3) * F.lit(1.0))


def threshold(value: float | None, default: float) -> float:
    """None and 0 stand for the default."""
    return value or default
