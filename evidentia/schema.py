"""Schemas of the tables as DDL, and the closed vocabulary of candidate fields."""

from __future__ import annotations

# The fields a candidate may be about.
KNOWN_FIELDS = [
    "composer", "title", "work_title", "movement", "movement_title", "catalog", "key", "form", "instrumentation",
    "arranger", "publisher", "edition", "period", "tempo",
]
REQUIRED_FIELDS = ["composer", "title"]

SIGNALS = (
    "collection_id long, rel_path string, size long, mtime double, page_count int, sha256 string, "
    "docinfo map<string,string>, outline array<struct<title:string,page_index:int,level:int>>, page_text map<int,string>, error string"
)
CANDIDATE = "piece_id long, field string, value string, source string, weight double, seq long, adapter string, note string, accepted boolean"
#: What is stored of a piece: what was given, then what is derived from its candidates.
PIECE = (
    "piece_id {id}, review_state string, ingest_notes array<string>, auto_accept double, review_floor double, composer_name string, title string, work_title string, movement int, "
    "movement_title string, catalog_display string, music_key string, form string, instrumentation string, arranger string, publisher string, edition string, confidence double, route string, notes array<string>"
)
#: A file that was taken in: the batch that did it, and done or the reason why it makes no piece.
TAKEN = "file_key string, sha256 string, batch long, status string"
EVENT = "seq long, kind string, piece_id long, field string, value string, source string, weight double, note string"
