"""Column functions: text, model output, vectors and routing."""
