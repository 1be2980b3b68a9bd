"""editrisk - a Spark-native feature and scoring engine for ordered edit logs.

Sub-packages:

* ``sources``   - declared schema, CSV/Parquet loading, test tables, sinks
* ``functions`` - Column expressions (imputation, scaling, text classes)
* ``operators`` - fit/transform steps, running operators, statistics,
  ROC/PR curves, session (multiple-instance) scoring, models
* ``plans``     - feature catalog, the batched feature pipeline, system runs
"""

__version__ = "0.1.0"
