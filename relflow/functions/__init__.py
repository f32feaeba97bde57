"""User functions over rows and registered sources."""
