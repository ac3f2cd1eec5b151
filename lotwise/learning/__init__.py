"""Estimators: encoders, quantile boosting and its evaluation."""
