"""Training-data operators over the package's own records: segments, messages, steps and skills."""
