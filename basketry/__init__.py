"""Next-purchase recommendation at table scale, written with the PySpark DataFrame API."""

__version__ = "0.1.0"
