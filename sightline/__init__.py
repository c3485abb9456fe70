"""PySpark-native search-visibility analytics: plain functions from DataFrames to DataFrames."""
