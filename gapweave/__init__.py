"""Fill gaps in tables from many collected pages, as Spark jobs."""
