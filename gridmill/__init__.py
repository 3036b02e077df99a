"""gridmill: place search, urban analytics and corpus preparation on Apache Spark."""
