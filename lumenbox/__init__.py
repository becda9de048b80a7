"""Image containers and AV1 still-image streams as tables of a Spark session."""
