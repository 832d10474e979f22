"""tidemark: a Spark-native engine for labelled time series, with a training-data subpackage beside it."""
