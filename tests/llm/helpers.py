"""Small document tables with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def documents(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, f"src{i % 3}"), len(t or "")) for i, t in enumerate(texts)]
    return frame(spark, rows)


def with_clashes(df, *names):
    """df with extra columns named like an operator's own."""
    for n in names:
        df = df.withColumn(n, df["doc_id"] * 0 + 7)
    return df


def sf(name):
    return f"/root/testdata/sf0.001/{name}.parquet"


__all__ = ["SCHEMA", "T", "documents", "frame", "sf", "with_clashes"]
