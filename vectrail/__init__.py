"""Vector search, clustering and corpus preparation as Spark DataFrame plans."""

VERSION = "0.1.0"
