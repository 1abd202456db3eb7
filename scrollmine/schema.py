"""Schemas of the engine's tables (the vector's dimension is a parameter of the store, not of the type)."""

from __future__ import annotations

from pyspark.sql import types as T

_f = T.StructField
FILES = T.StructType([_f("file_id", T.LongType(), False), _f("file_path", T.StringType(), False), _f("mtime", T.LongType(), False), _f("indexed_at", T.LongType(), False), _f("chunk_count", T.LongType(), False)])
CHUNKS = T.StructType(
    [
        _f("chunk_id", T.LongType(), False), _f("file_id", T.LongType(), False), _f("chunk_index", T.IntegerType(), False), _f("date", T.StringType()), _f("section", T.StringType()),
        _f("project", T.StringType()), _f("start_line", T.IntegerType(), False), _f("end_line", T.IntegerType(), False), _f("content", T.StringType(), False), _f("memory_type", T.StringType()),
    ]
)
EMBEDDINGS = T.StructType([_f("chunk_id", T.LongType(), False), _f("content_hash", T.LongType(), False), _f("embedding", T.ArrayType(T.FloatType(), False), False)])
POSTINGS = T.StructType([_f("term", T.StringType(), False), _f("chunk_id", T.LongType(), False), _f("positions", T.ArrayType(T.IntegerType(), False), False)])
DOC_STATS = T.StructType([_f("chunk_id", T.LongType(), False), _f("length", T.LongType(), False)])
RESULT = T.StructType(
    [
        _f("file_path", T.StringType(), False), _f("start_line", T.LongType(), False), _f("end_line", T.LongType(), False), _f("content", T.StringType(), False), _f("score", T.DoubleType(), False),
        _f("date", T.StringType()), _f("section", T.StringType()), _f("project", T.StringType()), _f("memory_type", T.StringType()),
    ]
)
