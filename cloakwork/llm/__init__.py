"""Training-data operators: ten corpus-scale tools that nothing else in the library imports."""
