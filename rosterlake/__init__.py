"""rosterlake: Spark jobs that turn messy people-and-account lists into a clean, queryable library."""
