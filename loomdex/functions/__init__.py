"""Scalar functions on columns: words, stems, tokens, comments, classifiers."""
