"""Scrollmine: hybrid text retrieval over document collections, as PySpark DataFrames."""
