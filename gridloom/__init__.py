"""Panel time-series retrieval forecasting and its evaluation, as DataFrame operators."""

__version__ = "0.3.0"
