"""Readers of series and the series views of the driver's tables."""
