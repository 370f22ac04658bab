"""Spark-first analytics for re-evaluating short-oligonucleotide assays at scale."""
