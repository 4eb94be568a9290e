"""Tables, their columns, and the engine's fixed numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        *(T.StructField(c, T.StringType()) for c in ("corpus", "root", "path", "language", "signature", "kind", "package")),
        *(T.StructField(c, T.IntegerType()) for c in ("line", "end_line", "shell_number")),
        T.StructField("embed_text", T.StringType()),
    ]
)
EDGES = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("kind", T.StringType())])
TOMBSTONES = T.StructType([T.StructField("node_id", T.LongType(), False), T.StructField("deleted_at", T.LongType())])
EMBEDDINGS = T.StructType(
    [T.StructField("node_id", T.LongType()), T.StructField("model_id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("text_hash", T.StringType())]
)
META = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType(), False)])

# Kinds of nodes that describe structure, and the kind of prose.
STRUCTURAL_KINDS = ("file", "file-module", "import", "module", "field", "variable")
DOC_KIND = "doc-chunk"
# Limits of batches, budgets and candidates.
MAX_SEQ = 512
MAX_BATCH = 512
TOTAL_TOKEN_BUDGET = 8192
MIN_TOKEN_BUDGET = 1024
TOKEN_BUDGET = 4096
ROWS_OF_SEQ = {32: 128, 64: 64, 128: 32, 256: 16, 512: 8}
FLUSH_ROWS = 500
FLUSH_SECONDS = 30
PENDING_CHUNK_ROWS = 50_000
DOC_VERIFY_MAX_ROWS = 200_000
NEIGHBOURS = 5
NEIGHBOUR_CHARS = 60
FTS_TERMS = 3
FTS_MIN_BYTES = 4
FTS_CANDIDATES = 20
MEMO_SECONDS = 60
RELOAD_SECONDS = 5
# Engine preferences.
PREF_ACCELERATED = 100
PREF_PREFERRED_CPU = 50
PREF_UNIVERSAL_CPU = 10


def migrate(df: DataFrame, schema: T.StructType = EMBEDDINGS) -> DataFrame:
    """The columns of `schema`, in its order and types; those that df lacks are null, so an older table's hashes are unknown."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
