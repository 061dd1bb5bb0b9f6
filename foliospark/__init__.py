"""A PySpark engine for document indexing, retrieval and analytics."""
