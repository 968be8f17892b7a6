"""PySpark-native engine for labelled synthetic inspection datasets."""
