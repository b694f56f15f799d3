"""quern: a PySpark-native engine for corpus curation, record logs and operational analytics."""
