"""From query strings to DataFrame plans, and the JSON API on top."""
