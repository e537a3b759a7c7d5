"""freightloom: order-line analytics written as Spark DataFrame jobs."""
