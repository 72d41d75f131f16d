"""The staged pipeline, the query catalog and the SQL each query is checked against."""
