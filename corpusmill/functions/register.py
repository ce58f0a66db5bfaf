"""Functions for SQL text: ``register(spark)`` names them in the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import grounding, vectors


def register(spark: SparkSession) -> list[str]:
    """Vectorised functions, by the names that are given back."""
    known = {
        "quote_coverage": grounding.quote_coverage, "fold_spaces": grounding.normalised, "fold_marks": grounding.normalised_marks,
        "pack_vector": vectors.pack, "unpack_vector": vectors.unpack,
    }
    for name, function in known.items():
        spark.udf.register(name, function)
    return list(known)
