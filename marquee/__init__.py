"""marquee: a Spark-first analytics engine for public event listings."""

__all__ = ["session", "schemas"]
__version__ = "0.1.0"
