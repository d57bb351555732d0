"""Column functions over text, skills and scores."""
