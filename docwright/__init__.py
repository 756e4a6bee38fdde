"""docwright: DataFrame operators for document analytics."""
