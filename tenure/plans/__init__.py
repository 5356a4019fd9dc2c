"""Plan inspection and join-side sizing."""
