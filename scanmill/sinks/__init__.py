"""Writers: statistics, dictionary, vectors, text dumps and run files."""
