"""herald: bulk-notification data pipelines expressed as Spark DataFrame jobs."""
