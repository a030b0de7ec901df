"""Training-data operators. Nothing outside this folder imports it."""
