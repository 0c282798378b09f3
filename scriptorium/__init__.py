"""scriptorium: document-corpus analytics as PySpark dataflow."""
