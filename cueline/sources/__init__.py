"""Sources, checks of incoming rows, and sinks."""
