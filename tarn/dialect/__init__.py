"""PostgreSQL-flavoured SQL, translated to Spark SQL text."""
