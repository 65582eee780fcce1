"""factorloom: harmonised environmental-factor tables as Spark DataFrame jobs.

Every operator takes and returns ``DataFrame`` or ``Column`` objects, so
planning, pruning, code generation and spilling stay with Spark.
"""

__version__ = "0.1.0"
