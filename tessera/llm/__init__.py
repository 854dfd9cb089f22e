"""Training-data operators at corpus scale; self-contained, imported by nothing else in the package."""
