"""Spark jobs for building, searching and analysing text knowledge bases."""
