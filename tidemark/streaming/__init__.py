"""Event-time jobs. Each takes a batch or a streaming DataFrame alike."""
