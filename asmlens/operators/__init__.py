"""Operators on alignments, contigs, labels, scores and tables: DataFrames in, DataFrames out."""
