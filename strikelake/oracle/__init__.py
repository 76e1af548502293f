"""The same results in DuckDB SQL, written independently of the Spark operators."""
