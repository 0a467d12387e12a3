"""DataFrame -> DataFrame operators of the scan, policy, change and audit families."""
