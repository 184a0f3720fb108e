"""Training-data operators: ten jobs over text corpora, each in a module of its own."""
