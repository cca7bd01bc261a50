"""Vector files and tables as DataFrames (external_id, vector)."""

from .graphs import import_vamana, read_graph  # noqa: F401
from .vectors import autodetect, blocks_to_vectors, coo_to_vectors, load_as_matrix, read_ids, read_vectors, source_metadata, write_vectors  # noqa: F401
