"""Moving-object analytics on Spark."""
