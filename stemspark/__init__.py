"""Package for forest inventories from point clouds, on Spark."""
