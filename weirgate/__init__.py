"""weirgate: a PySpark-native curation engine for instruction-tuning corpora."""
