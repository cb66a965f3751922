"""Table schemas of the complaint and legal layers."""

from __future__ import annotations

from pyspark.sql import types as T

STR, INT, LONG, DOUBLE, BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
STRS, FLOATS = T.ArrayType(STR), T.ArrayType(T.FloatType())


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


CALLS = _schema(
    call_id=LONG, pincode=STR, hindi_audio_text=STR, timestamp=STR, call_duration_seconds=LONG, audio_source=STR
)
SILVER = _schema(
    call_id=STR, pincode=STR, raw_text=STR, english_text=STR, contractor_name=STR, work_site=STR, issue_type=STR,
    violence_threatened=BOOL, worker_count_mentioned=INT,
)
GOLD = _schema(
    pincode=STR, contractor_name=STR, total_complaints=LONG, issue_types_reported=STRS, violence_flagged=BOOL,
    total_workers_affected=LONG, work_sites=STRS, threat_label=STR, severity_score=LONG, escalate_immediately=BOOL,
)
RADAR = _schema(
    contractor_name=STR, pincode=STR, lat=DOUBLE, lon=DOUBLE, total_complaints=LONG, severity_score=DOUBLE,
    primary_issue=STR,
)
PAGES = _schema(doc_id=STR, page_number=LONG, raw_text=STR)
SECTIONS = _schema(section_id=STR, section_num=STR, title=STR, content=STR, source=STR)
SCHEMES = _schema(scheme_name=STR, eligibility=STR, benefits=STR, application=STR)
CHUNKS = _schema(chunk_id=STR, content=STR, source=STR)
VECTORS = _schema(chunk_id=STR, content=STR, source=STR, embedding=FLOATS)
#: A sparse vector: its buckets in ascending order, and their weights
SPARSE = _schema(buckets=T.ArrayType(INT), weights=T.ArrayType(INT))
TEXT_VECTORS = _schema(chunk_id=STR, content=STR, source=STR, embedding=SPARSE)
ENTITIES = _schema(
    contractor_name=STR, work_site=STR, issue_type=STR, violence_threatened=BOOL, worker_count_mentioned=INT
)
ACTION = _schema(bns_sections_cited=STRS, action_steps=STRS, government_portal=STR, urgency=STR)
ACTION_LOG = _schema(
    call_id=STR, pincode=STR, issue_type=STR, threat_level=STR, bns_sections_cited=STR, action_steps=STR,
    government_portal=STR, urgency=STR, retrieved_chunks=STR, timestamp=STR,
)
SCENARIOS = _schema(issue_type=STR, threat_label=STR, contractor_name=STR, pincode=STR, complaint_count=LONG)
