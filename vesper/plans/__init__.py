"""The query catalogue: each operator over the tables of a folder, and DuckDB SQL for the same rows."""
