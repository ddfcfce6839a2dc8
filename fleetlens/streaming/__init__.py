"""The onset, burst, scoring and miss logic on Structured Streaming."""
