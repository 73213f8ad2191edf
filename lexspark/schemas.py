"""Schemas of the stored tables. Nested values are native arrays, structs and maps."""

from __future__ import annotations



JUDGES = "array<struct<name:string,role:string,note:string>>"
JUDGMENTS = (
    "source string, doc_id string, signature string, doc_type string, doc_type_raw string, court string, division string, "
    "judgment_date date, publication_date date, outcome string, purchaser string, excerpt string, panel array<string>, "
    f"thematic array<string>, chairman string, legal_basis string, importance string, sentencja string, uzasadnienie string, "
    f"full_text string, judges {JUDGES}, source_url string, first_seen_at timestamp, last_seen_at timestamp"
)
ACTS = (
    "publisher string, year int, pos int, eli string, address string, title string, act_type string, status string, "
    "in_force string, promulgation_date date, announcement_date date, entry_into_force_date date, released_by array<string>, "
    "keywords array<string>, act_references map<string,array<struct<id:string>>>, has_jednolity boolean, full_text string, "
    "text_source string, source_url string, changed_at string, first_seen_at timestamp, last_seen_at timestamp"
)
RUNS = "started_at timestamp, finished_at timestamp, source string, pages int, seen int, added int, status string, detail string"
SKIPPED = "source string, doc_id string, reason string, skipped_at timestamp"
HITS = (
    "source string, doc_id string, signature string, doc_type string, court string, division string, judgment_date date, "
    "publication_date date, panel array<string>, thematic array<string>, excerpt string, outcome string, source_url string"
)
RAW_PAGES = "source string, kind string, doc_id string, url string, fetched_at timestamp, html string"
KEY = ("source", "doc_id")
ACT_KEY = ("publisher", "year", "pos")
#: What a rendered table's block begins with.
SENTINEL = "@@TABLE@@"
