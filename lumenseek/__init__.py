"""lumenseek: hybrid text and code retrieval on DataFrames."""

__version__ = "0.1.0"
