"""The per-session state machine, in batch and as a stream."""
