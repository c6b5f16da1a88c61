"""Daily forecasting features, stacked tree ensembles and feature importance on Spark."""

__version__ = "0.1.0"
