"""ragtide: the data side of retrieval-augmented question answering as
PySpark DataFrame operators (ingest, chunking, exact/approximate vector
search, keyword search, corpus statistics, context assembly, history)."""

__version__ = "0.1.0"
