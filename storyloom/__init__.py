"""storyloom: narrative-graph analytics as Spark jobs over tables of many works."""
