"""axisweave: Spark-native analytics over intervals on a stranded linear axis."""
