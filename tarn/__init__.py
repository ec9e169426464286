"""tarn: a PostgreSQL-flavoured analytics engine on Apache Spark."""
