"""Spark-native preparation, classification and evaluation of alert tables."""

from alertloom.spec import ALERTS, FeatureSpec

__all__ = ["ALERTS", "FeatureSpec"]
