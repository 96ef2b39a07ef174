"""The three end-to-end analyses, composed from the operators."""

from lodestat.plans.flows import (
    DetectionLimits,
    criteria_report,
    detection_limits,
    prepare_measurements,
    storm_against_base,
    trend_report,
)

__all__ = ["DetectionLimits", "criteria_report", "detection_limits", "prepare_measurements",
           "storm_against_base", "trend_report"]
