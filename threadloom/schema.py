"""Schemas of the engine's tables.  Sessions are keyed by ``uri``; wide text stands in turns and chunks only."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SESSION = _struct(
    uri=_S, source_id=_S, native_id=_S, title=_S, preview=_S, workspace_path=_S, repository=_S, branch=_S, agent=_S, models=T.ArrayType(_S),
    created_at=_TS, updated_at=_TS, message_count=_I, tool_call_count=_I, total_tokens=_L, cost=_D, additions=_I, deletions=_I, files_changed=_I,
    is_archived=_B, parent_native_id=_S, content_hash=_S,
)
#: A tagged union: ``kind`` is text, reasoning, tool or patch.
BLOCK = _struct(kind=_S, text=_S, tool_name=_S, title=_S, input_json=_S, output=_S, status=_S, duration_ms=_L, call_id=_S, path=_S, diff=_S, additions=_I, deletions=_I)
TURN = _struct(uri=_S, turn_index=_I, role=_S, timestamp=_TS, model=_S, agent=_S, blocks=T.ArrayType(BLOCK))
CHUNK = _struct(uri=_S, ordinal=_I, turn_index=_I, role=_S, timestamp=_TS, text=_S, is_embeddable=_B)
SESSION_FILE = _struct(uri=_S, path=_S, tool=_S, turn_index=_I)
SESSION_REF = _struct(uri=_S, ref_type=_S, ref_value=_S, turn_index=_I)
EMBEDDING = _struct(uri=_S, ordinal=_I, vector=T.ArrayType(T.FloatType()))
TAG = _struct(uri=_S, tag=_S, origin=_S, created_at=_TS)
SOURCE_STATE = _struct(source_id=_S, change_cursor=_S, last_indexed=_TS, session_count=_L, chunk_count=_L)
