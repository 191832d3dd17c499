"""Analytics on robot, drone and IoT logs at fleet scale, as Spark plans."""
