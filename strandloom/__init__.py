"""Strandloom: sequence collections, variation graphs and alignments as Spark DataFrames."""
