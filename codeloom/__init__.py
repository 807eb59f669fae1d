"""Spark-native building, refining and analysing of labelled source-code datasets."""
