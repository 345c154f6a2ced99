"""Statistics kept up to date over streams."""
