"""Part of the provenant engine."""
