"""marktlens: a Spark-native price-intelligence engine."""
