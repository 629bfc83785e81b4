"""Named queries over the driver's tables, each with the DuckDB SQL that it must agree with."""
