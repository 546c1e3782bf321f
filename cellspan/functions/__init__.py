"""Column functions and driver-side helpers on byte keys."""
