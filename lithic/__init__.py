"""Exam-document structuring and corpus operators as PySpark DataFrame transformations."""
