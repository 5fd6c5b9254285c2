"""The experiment's three analyses as compositions of operators."""
