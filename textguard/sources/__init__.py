"""Rules, settings, landed provider responses and requests as DataFrames."""
