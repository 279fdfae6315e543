"""PySpark-native retrieval, usage analytics and corpus preparation."""
