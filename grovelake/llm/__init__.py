"""Training-data operators on texts; nothing else in the library imports this subpackage."""
