"""Training-data operators: ten numbered operators, each a module with a general function and its query."""
