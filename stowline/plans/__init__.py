"""What a user asks for: organise, find and quarantine duplicates, history, undo."""
