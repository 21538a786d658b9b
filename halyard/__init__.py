"""Halyard: stochastic control and Monte Carlo analytics on PySpark."""

__version__ = "0.1.0"
