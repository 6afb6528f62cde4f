"""The archive's tables: column order and types."""

from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType

_S, _T, _I = StringType(), TimestampNTZType(), IntegerType()


def _table(*columns: tuple) -> StructType:
    return StructType([StructField(n, t) for n, t in columns])


CONVERSATIONS = _table(("id", _S), ("source", _S), ("title", _S), ("created_at", _T), ("updated_at", _T), ("model", _S), ("cwd", _S), ("git_branch", _S), ("project_id", _S), ("metadata", _S))
MESSAGES = _table(("id", _S), ("conversation_id", _S), ("role", _S), ("content", _S), ("thinking", _S), ("created_at", _T), ("model", _S), ("metadata", _S), ("embedding", ArrayType(FloatType())), ("parent_id", _S))
TOOL_CALLS = _table(("id", _S), ("message_id", _S), ("tool_name", _S), ("input", _S), ("output", _S), ("status", _S), ("duration_ms", _I), ("created_at", _T))
ATTACHMENTS = _table(("id", _S), ("message_id", _S), ("filename", _S), ("mime_type", _S), ("size", _I), ("path", _S), ("url", _S), ("created_at", _T))
ARTIFACTS = _table(("id", _S), ("conversation_id", _S), ("artifact_type", _S), ("title", _S), ("content", _S), ("language", _S), ("created_at", _T), ("version", _I))
FILE_EDITS = _table(("id", _S), ("message_id", _S), ("file_path", _S), ("edit_type", _S), ("content", _S), ("created_at", _T), ("old_content", _S))
CHANGES = _table(("kind", _S), ("entity", _S), ("generation", LongType()))

TABLES = {"conversations": CONVERSATIONS, "messages": MESSAGES, "tool_calls": TOOL_CALLS, "attachments": ATTACHMENTS, "artifacts": ARTIFACTS, "file_edits": FILE_EDITS}
