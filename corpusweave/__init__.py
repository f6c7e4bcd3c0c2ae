"""corpusweave: document retrieval and corpus maintenance as Spark plans."""
