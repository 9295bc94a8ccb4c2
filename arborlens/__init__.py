"""Source-corpus analytics on Spark: many repositories, one DataFrame of files."""

__version__ = "0.1.0"
