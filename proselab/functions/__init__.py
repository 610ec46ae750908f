"""proselab subpackage."""
