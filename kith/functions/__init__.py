"""Column functions: JVM-side expressions, no Python workers."""

from kith.functions.scalars import (
    append_if, bucket_label, bucket_number, compare, exact_sum, flag_keywords, meta_get, metadata_map,
    same_value, step_fields, tenure_months, to_int,
)
from kith.functions.text import row_text, text_field, text_map, token_pairs
from kith.functions.vectors import hash_bucket, hash_vector, to_doubles, unit_vector

__all__ = [
    "append_if", "bucket_label", "bucket_number", "compare", "exact_sum", "flag_keywords", "hash_bucket",
    "hash_vector", "meta_get", "metadata_map", "row_text", "same_value", "step_fields",
    "tenure_months", "text_field", "text_map", "to_doubles", "to_int", "token_pairs",
    "unit_vector",
]
