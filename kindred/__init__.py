"""kindred: entity resolution and embedding analytics expressed as Spark plans."""
