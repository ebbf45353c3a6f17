"""Reading corpora, seeds and indexes; writing results."""

from kith.sources.readers import in_domain, read_index, read_seeds, read_table, seed_record
from kith.sources.workspace import new_folder
from kith.sources.writers import append_index, append_log, write_csv, write_result

__all__ = [
    "append_index", "append_log", "in_domain", "new_folder", "read_index", "read_seeds",
    "read_table", "seed_record", "write_csv", "write_result",
]
