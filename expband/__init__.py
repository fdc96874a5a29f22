"""Experience banding of job postings as Spark jobs."""
