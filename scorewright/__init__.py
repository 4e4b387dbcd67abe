"""Analytics over large tables of scored evaluation runs, written for Spark."""

__version__ = "0.1.0"
