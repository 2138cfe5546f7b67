"""Reading, typed import, export and dumps."""
