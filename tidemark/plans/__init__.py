"""Building blocks of iterative and interval plans."""
