"""Writers. These start Spark jobs."""
