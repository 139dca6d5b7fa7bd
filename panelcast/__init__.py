"""panelcast: forecasting datasets and blocked validation for entity/time panels on Spark.

Functions take and return DataFrames.  Those whose intermediate tables are
read several times write them to the checkpoint folder while they are called.
Subpackages:

* ``sources``   - table readers and report sinks
* ``functions`` - column expressions (cleaning, dates, labels, formatting)
* ``operators`` - DataFrame -> DataFrame building blocks (series, folds,
  metrics, baselines, fold statistics, neighbours, models, explanations)
* ``plans``     - end-to-end compositions (observed weekly validation,
  daily interpolated horizons) and the driver-table panel used in tests
"""

from panelcast.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
