"""Spark-first building blocks of the morphlake text-analytics engine."""
