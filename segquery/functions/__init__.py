"""segquery subpackage."""
