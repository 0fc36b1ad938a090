"""Spark-native analytics for annotated image regions and the text that describes them."""
