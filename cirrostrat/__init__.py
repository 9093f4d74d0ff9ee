"""Point-cloud analytics on Spark: packets to frames, ground removal, clustering, packed clouds."""

__version__ = "0.1.0"
