"""plotflux: Spark data jobs for replicated field experiments.

Every public function takes DataFrames and column names and returns a
DataFrame (or a Column), so jobs are built by ordinary composition.
"""

from plotflux.session import build_session

__all__ = ["build_session"]
