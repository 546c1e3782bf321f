"""From a scan description to a DataFrame plan."""
