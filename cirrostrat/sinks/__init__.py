"""Where messages go."""
