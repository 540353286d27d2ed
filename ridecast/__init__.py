"""ridecast: ride-demand features and tree-ensemble forecasting on Spark.

Layout
------
sources/    table loading, CSV scan/sink, travel-time tables
functions/  Column -> Column helpers (calendar, clock, math)
operators/  DataFrame -> DataFrame operators (counts, codes, scaling, joins, folds, metrics)
plans/      composed flows (ride features, forecast) and the query catalogue
models/     MLlib estimators, bagging, stacking and parameter search
streaming/  the ride-count operator over a file stream
"""

__version__ = "0.1.0"
