"""Typed readers and writers of FASTA, GFA, GAF, manifests and feature tables."""
