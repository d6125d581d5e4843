"""Jobs over file streams."""
