"""Training-data operators: extraction, filtering, deduplication, search, sharding and tokenisation.

Nothing outside this package imports it; ``registry`` holds its queries and their oracle SQL.
"""
