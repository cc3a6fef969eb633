"""Training-data operators: ten stand-alone components for corpus preparation."""
