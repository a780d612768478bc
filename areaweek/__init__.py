"""Weekly risk analytics for geographic units, expressed as Spark plans."""

__version__ = "0.1.0"
