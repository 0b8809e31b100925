"""Spark jobs that build, tokenize, stream and score labelled markup corpora."""
