"""folio: a PySpark-native document-analytics engine."""
