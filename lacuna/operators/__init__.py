"""Cleaning, erasing, imputing and scoring."""

from .classify import forest_impute, impute_by, perceptron_impute, plan_training, tree_impute
from .clean import cast_features, feature_array, filter_numeric, project_attributes
from .compiled import node_table, perceptron_class, tree_class, walk_nodes, weight_table
from .hashed import knn_impute_hashed, nearest_hashed
from .missing import erase, erase_exact, erased_rows, exactly_erased_rows, in_training_part, split
from .neighbours import distance_to_row, knn_impute, majority, nearest, nearest_by_step, places_of, votes
from .score import score_codes, score_detail, summarize

__all__ = [
    "cast_features",
    "distance_to_row",
    "erase",
    "erase_exact",
    "erased_rows",
    "exactly_erased_rows",
    "feature_array",
    "filter_numeric",
    "forest_impute",
    "impute_by",
    "in_training_part",
    "knn_impute",
    "majority",
    "knn_impute_hashed",
    "nearest",
    "nearest_hashed",
    "nearest_by_step",
    "node_table",
    "perceptron_impute",
    "perceptron_class",
    "places_of",
    "plan_training",
    "project_attributes",
    "score_codes",
    "score_detail",
    "split",
    "summarize",
    "tree_class",
    "tree_impute",
    "votes",
    "walk_nodes",
    "weight_table",
]
