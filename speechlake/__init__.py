"""A Spark-native engine for speech-corpus curation and speech-recognition evaluation."""
