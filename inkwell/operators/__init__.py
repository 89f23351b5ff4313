"""Search operators: each takes a snapshot and gives a plan.  Only regular expressions and fuzzy terms look into the dictionary at once, for the terms to push down."""
