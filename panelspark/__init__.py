"""A PySpark-native engine for daily cross-sectional panels and the research built on them."""
