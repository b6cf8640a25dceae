"""Data governance on Spark: quality rules, profiles, entity resolution, lineage and governance tables."""
