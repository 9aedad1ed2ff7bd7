"""duskwire: threat-intelligence correlation as Spark DataFrame and streaming jobs."""
