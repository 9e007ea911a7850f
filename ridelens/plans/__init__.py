"""Reports (dashboard panels) and the query catalogue with its SQL oracle."""
