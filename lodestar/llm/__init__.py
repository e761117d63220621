"""Training-data operators: ten corpus stages, each usable alone or in a pipeline."""
