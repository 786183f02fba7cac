"""Regional indicator analytics on Apache Spark.

Messy tabular sources become prepared, validated and published observations;
published observations become scores, rankings, benchmarks and coverage.
Everything is a ``Column`` builder or a ``DataFrame -> DataFrame`` function.
"""

from civigrade.session import build_session, scratch_folder

__all__ = ["build_session", "scratch_folder"]
