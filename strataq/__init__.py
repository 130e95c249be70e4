"""Search, profile and archive semi-structured logs and records with Spark."""
