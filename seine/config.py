"""Fixed values of the search semantics."""

HAMMING_K, NUM_BITS, NUM_BLOCKS = 3, 64, 4
RETURN_SIZE = 100
MIN_IDF = 0.3
PROXIMITY_WEIGHT = 0.5
RELEVANCE_WEIGHT, RANK_WEIGHT = 0.85, 0.15
DAMPING, MAX_ITER, TOLERANCE = 0.85, 100, 1e-6
#: Importance of text under these elements; other text has 0.
IMPORTANCE = {"title": 2, "h1": 1, "h2": 1, "h3": 1, "b": 1, "strong": 1}
LOG_TF_PLACES, IDF_PLACES, RANK_PLACES = 4, 4, 6
