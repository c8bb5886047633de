"""Bilingual-corpus analytics and quality checks as Spark DataFrame operators."""

__version__ = "0.1.0"
