"""claimlens: claims-risk analytics as composable Spark DataFrame operators.

Layout:
  sources/    table readers, claim-shaped views over the driver tables, sinks
  functions/  pure Column builders (features, rules, exact arithmetic)
  operators/  DataFrame -> DataFrame operators (joins, aggregates, metrics, ML)
  plans/      composed pipelines and the query catalog (Spark query + DuckDB oracle)
  streaming/  Structured Streaming jobs
"""

from claimlens.config import DEFAULT_CONFIG, EngineConfig  # noqa: F401
from claimlens.session import get_session  # noqa: F401
