"""Building blocks from DataFrame to DataFrame."""
