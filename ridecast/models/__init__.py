"""Estimators (MLlib), bagging, stacking and parameter search."""
