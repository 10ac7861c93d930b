"""runeflow: a Spark-native engine for text, Unicode and font data."""
