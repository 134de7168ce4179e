"""Shoreline imagery and coastal climate analysis as Spark DataFrame compositions."""
