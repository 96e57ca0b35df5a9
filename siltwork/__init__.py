"""Analytics over document and mail corpora on Spark: ingest, search, mail threads, importance and retrieval quality."""
