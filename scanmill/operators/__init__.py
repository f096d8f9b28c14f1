"""DataFrame operators: statistics, dictionary, vectors, ranking, id mapping."""
