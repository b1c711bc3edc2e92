"""Bot and abuse risk analytics on web page-view events, as Spark jobs."""
