"""Reading and writing policy tables, requests, scores and fitted objects."""
