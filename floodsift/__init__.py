"""floodsift: decode, measure and filter network traffic for floods with Spark."""

__version__ = "0.1.0"
