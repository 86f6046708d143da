"""Column expressions: paths, words, similarity, bits and display."""
