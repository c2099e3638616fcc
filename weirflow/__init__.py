"""Line, record and corpus pipelines as Spark DataFrame jobs."""
