"""Security and composition audit jobs on Spark: functions from DataFrames to DataFrames."""
