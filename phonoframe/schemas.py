"""Schemas of the tables that cross the library boundary."""

from pyspark.sql import types as T

_TYPES = {"STRING": T.StringType, "INT": T.IntegerType, "DOUBLE": T.DoubleType, "BOOLEAN": T.BooleanType}


def _struct(columns: str) -> T.StructType:
    """Schema from "name TYPE, ..." without a running session."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]()) for name, kind in pairs])


TOKEN_RECORD = _struct(
    "utterance_id STRING, token_index INT, corpus STRING, l1 STRING, split STRING, label STRING, "
    "substituted_with STRING, audio_path STRING, start_s DOUBLE, end_s DOUBLE, alignment STRING, "
    "reason STRING, audio_problem BOOLEAN, score DOUBLE, best_confusion STRING, heard STRING, "
    "hearing_score DOUBLE, gop DOUBLE, verdict STRING, confidence DOUBLE, spike_score DOUBLE, "
    "vote_fraction DOUBLE, alignment_confidence DOUBLE, wall_ms DOUBLE"
)
SCORES = "map<string, struct<words: array<struct<text: string, phones: array<string>>>>>"
LABEL_COLUMNS = [
    "filename", "label", "l1", "utterance_id", "token_index", "target_phone", "start_s", "end_s",
    "duration_s", "split",
]
LABELS = _struct(
    "filename STRING, label STRING, l1 STRING, utterance_id STRING, token_index INT, "
    "target_phone STRING, start_s DOUBLE, end_s DOUBLE, duration_s DOUBLE, split STRING"
)
UTTERANCE = _struct(
    "utterance_id STRING, audio_path STRING, transcript STRING, l1 STRING, split STRING, "
    "corpus STRING, speaker STRING"
)
