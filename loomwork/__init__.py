"""Analytics over agent transcripts, expressed as lazy Spark DataFrame transforms."""
