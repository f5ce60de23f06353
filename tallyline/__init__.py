"""tallyline: Spark DataFrame operators for incident tables, dataset catalogs and interval tables."""

__version__ = "0.1.0"
