"""Scalar and array functions as Spark SQL text: used by expr(), by SQL, and by registered SQL functions alike."""
