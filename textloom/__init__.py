"""textloom: a Spark-native engine for curating, checking and measuring text corpora."""
