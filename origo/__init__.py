"""Point-in-time correct customer panels and their validation, on Spark."""
