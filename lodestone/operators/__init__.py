"""Training, assignment, probing and ranking."""

from .assign import assign
from .batch import exact_search_all, ivf_search_all, probes_for
from .kmeans import lloyd_step, sample_size, seeded_centroids, train, training_sample
from .probe import candidates, cap_round_robin, rank_clusters
from .topk import exact_topk, rank_candidates

__all__ = [
    "assign", "candidates", "cap_round_robin", "exact_search_all", "exact_topk", "ivf_search_all", "lloyd_step",
    "probes_for", "rank_candidates", "rank_clusters", "sample_size", "seeded_centroids", "train", "training_sample",
]
