"""The registered queries: each applies an operator to a whole table, with the same result in DuckDB SQL."""
