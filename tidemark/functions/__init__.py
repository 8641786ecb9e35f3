"""Part of the research engine."""
