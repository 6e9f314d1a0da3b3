"""Message-log and table sources."""
