"""Manifest algebra and corpus analytics on Spark DataFrames."""
