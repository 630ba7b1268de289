"""What the driver runs: views over the test tables, the query registry and the SQL to compare with."""
