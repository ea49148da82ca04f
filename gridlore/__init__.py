"""gridlore: a PySpark engine for gridded species-occurrence data."""
