"""Multi-step jobs composed from the operators."""
