"""Training-data operators: ten components over documents, pages and the benchmark."""
