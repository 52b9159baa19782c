"""Event-locked tracking time series on Spark: ingest, exclusion, smoothing, baseline,
two-stage means, condition contrast, tests over time and densities."""

from cuetrace.params import Params, TRACE_PARAMS
from cuetrace.plans.study import Study

__all__ = ["Params", "Study", "TRACE_PARAMS"]
