"""Spark table pipelines and pipeline analytics: functions from DataFrames to DataFrames."""
