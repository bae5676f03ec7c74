"""Payment, entitlement and run events: batch cores and their streams."""
