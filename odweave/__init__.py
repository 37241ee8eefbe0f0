"""odweave: origin-destination flow analytics, DataFrame in and DataFrame out."""

__version__ = "0.1.0"
