"""quillspark: retrieval over source code and documents, expressed as Spark plans."""
