"""lanemill: a Spark-first analytics engine for road-lane polylines and point clouds."""
