"""Values as text."""
