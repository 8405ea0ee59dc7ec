"""Uses the session of the whole test run."""
