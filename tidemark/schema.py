"""Shapes and vocabularies of the data model. Values are fixed: they have to match what stored documents hold."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, TS, B, I = T.StringType(), T.DoubleType(), T.TimestampType(), T.BooleanType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


LOCATION_TEXT = _struct(raw_text=S, district=S, state=S)
COMMON_RECORD = _struct(
    record_id=S, source_id=S, source_type=S, record_type=S, title=S, event_time=TS, location=LOCATION_TEXT,
    data=T.MapType(S, S), severity=S, status=S, source_url=S, retrieved_at=TS, raw_reference=S,
)
EVIDENCE = _struct(evidence_id=S, record_id=S, field=S, method=S, quote=S, char_start=I, char_end=I, text_hash=S)
PLACE = _struct(text=S, normalized_name=S, location_type=S, role=S, district=S, taluk=S, block=S, village=S, review=S, latitude=D, longitude=D, resolution=S, canonical_id=S, evidence_ids=T.ArrayType(S))
ENTITY = _struct(text=S, normalized_name=S, entity_type=S, review=S, evidence_ids=T.ArrayType(S))
CLAIM = _struct(field=S, value=S, method=S, confidence=D, review=S, evidence_ids=T.ArrayType(S))
INCIDENT = _struct(
    incident_id=S, record_id=S, source_id=S, source_url=S, record_kind=S, review=S, incident_type=S, category=S, department=S, severity=S, priority=S,
    event_status=S, event_time=TS, event_time_precision=S, declared_event_time=TS, retrieved_at=TS, district_hint=S, state_hint=S,
    locations=T.ArrayType(PLACE), entities=T.ArrayType(ENTITY), claims=T.ArrayType(CLAIM), evidence=T.ArrayType(EVIDENCE),
)

# Fixed values of the data model, in their order.
SEVERITIES = ["info", "low", "moderate", "high", "critical"]
PRIORITIES = ["low", "medium", "high", "critical"]
DATED = ["second", "minute", "hour", "day"]
OPEN_VALUES = ["unresolved", "other", "unknown"]
RECORD_KINDS = ["incident", "forecast", "context"]
REVIEW_STATES = ["accepted", "review_required"]
PLACE_LEVELS = ["state", "district", "taluk", "block", "village", "locality", "street", "landmark"]
MAP_SEVERITIES = ["critical", "high", "medium", "low"]
STATES = ["completed", "review_required", "failed", "deferred"]
