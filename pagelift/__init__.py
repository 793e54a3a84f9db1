"""Spark-native article extraction: tables of web pages in, tables of articles out."""
