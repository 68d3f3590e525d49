"""Spark jobs for chat archives: parsing, sessions, annotation, narrative, rollups, curation and publishing."""
