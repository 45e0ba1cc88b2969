"""Frame-level building blocks used by the plans."""
