"""Training-data operators: archives, joins, search, tokens, secrets, mixing and scoring."""
