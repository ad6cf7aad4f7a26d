"""cladeframe: phylogenetic community analytics as PySpark DataFrames."""

__version__ = "0.1.0"
