"""Table readers, table metadata and windowed exports."""
