"""Labelled-table preparation, ranking metrics and trial-log analytics on Spark DataFrames."""
