"""PySpark-native document analytics and retrieval-augmented question answering."""
