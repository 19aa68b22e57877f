"""Governed-graph and evaluation analytics as Spark DataFrame operators."""
