"""PySpark-native engine for curating conversational fine-tuning datasets."""
