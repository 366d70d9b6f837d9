"""User-facing operators, each `DataFrame -> DataFrame` or a fitted model."""
