"""storyloom: ranked, de-duplicated story feeds and corpus preparation as Spark jobs."""
