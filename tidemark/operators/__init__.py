"""Search language, timeline queries and tagging rules as column expressions and DataFrame plans."""
