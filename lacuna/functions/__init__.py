"""Column expressions: text checks, category codes, distances and hash marks."""

from .codes import Encoder, as_encoder, category_of, code_of, discover_codes, fit_encoder
from .distance import euclidean, squared_distance
from .hashing import below_percent, hash_text, percent_cut
from .text import NUMERIC_PATTERN, is_number, to_double, to_long, to_text

__all__ = [
    "Encoder",
    "NUMERIC_PATTERN",
    "as_encoder",
    "below_percent",
    "category_of",
    "code_of",
    "discover_codes",
    "euclidean",
    "fit_encoder",
    "hash_text",
    "is_number",
    "percent_cut",
    "squared_distance",
    "to_double",
    "to_long",
    "to_text",
]
