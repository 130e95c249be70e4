"""Multi-step work: archives, detection and routing."""
