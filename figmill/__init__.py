"""figmill: a PySpark-native engine for figure, panel, score and document manifests."""
