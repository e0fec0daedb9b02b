"""factloom: analytics over structured facts and long documents, written as Spark plans."""

__version__ = "0.1.0"
