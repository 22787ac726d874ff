"""Sources: tapes, dimensions and typed readers."""
