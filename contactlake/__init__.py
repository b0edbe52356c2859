"""Site-contact extraction and market scouting as Spark jobs over tables."""
