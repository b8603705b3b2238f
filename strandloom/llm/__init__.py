"""Training-data operators on text and vectors.  Nothing else in the library imports this subpackage."""
