"""Object search: read objects, embed them, search their vectors, and give the objects back."""

from .embeddings import ColPaliEmbedding, ColumnEmbedding, HashingEmbedding, ImageModelEmbedding, LangChainEmbedding, ObjectEmbedding, RandomEmbedding, ResNetEmbedding, SentenceEmbedding  # noqa: F401
from .index import ObjectIndex  # noqa: F401
from .readers import DirectoryImageReader, DirectoryTextReader, ObjectReader, TableReader, match_uri, text_of  # noqa: F401
