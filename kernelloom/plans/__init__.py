"""Forecasting pipelines and the registered queries."""
