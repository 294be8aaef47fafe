"""The library's operators by task, for use without knowing its modules."""

from __future__ import annotations

from quern.operators.blobs import analysed, compressed, decompressed, frames, joined_frames, measured, register_codec, smallest, train_dictionary, with_dictionary
from quern.operators.planning import created_on_miss, embedded, register_provider, semantic_lookup
from quern.operators.similarity import deduplicated, find_similar, match_class, signed
from quern.operators.tensors import compress, decompress, dct_1d, dct_2d, idct_1d, idct_2d, pack_int4, slerp, train_codebook, unpack_int4
from quern.session import local_session, scratch_path, share_code, table
from quern.sources.containers import append_new, blocks, contained, discover, read_fragments, read_to_quality, shards, state_changes, tensor_bytes, tensor_catalog, transformed, widened, write_fragments
from quern.streaming.flows import drained, followed, latest

__all__ = [n for n in dir() if not n.startswith("_") and n != "annotations"]
