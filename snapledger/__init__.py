"""snapledger: snapshot-style source data and training-corpus work as Spark DataFrame jobs."""
