"""Grouped operators: functions from DataFrame to DataFrame."""
