"""Training-data operations: each module holds one operator; ``queries`` registers them."""
