"""Folioscope: a PySpark-native engine for long-form documents and the facts drawn from them."""
