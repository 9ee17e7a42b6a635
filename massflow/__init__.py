"""massflow: planar mass transport and corpus preparation as Spark jobs."""
