"""corpuslab: Spark jobs that build, search, check and operate a question-answering corpus."""
