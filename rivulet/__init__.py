"""A product-analytics engine on Spark."""
