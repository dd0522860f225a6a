"""Row schemas shared by readers, operators and sinks, as DDL text."""

from __future__ import annotations

from briefloom.operators.order import KEY

# `seq` may also be a plain number, the place in one response
RAW_ITEM = (
    f"category STRING, seq {KEY}, title STRING, url STRING, `desc` STRING, source_name STRING, "
    "source_type STRING, published_at_raw STRING, tags ARRAY<STRING>, keyword_match STRING, "
    "recent_feature_signal BOOLEAN"
)

ITEM = (
    f"category STRING, seq {KEY}, title STRING, url STRING, `desc` STRING, source_name STRING, "
    "source_type STRING, published_at_raw STRING, published_at TIMESTAMP, tags ARRAY<STRING>, "
    "model_family_key STRING, release_family_key STRING, keyword_match STRING, "
    "recent_feature_signal BOOLEAN, priority INT"
)

REPORT_ITEM = (
    "report_id STRING, position INT, is_primary BOOLEAN, title STRING, url STRING, summary STRING, "
    "insight STRING, source_name STRING, source_type STRING, published_at_raw STRING, published_at TIMESTAMP"
)

REPORT = (
    "report_id STRING, title STRING, summary STRING, outlook STRING, outlook_label STRING, mode STRING"
)

QUOTE = (
    "symbol STRING, price DOUBLE, change DOUBLE, low DOUBLE, high DOUBLE, open DOUBLE, close DOUBLE, source STRING"
)

# `pos` is the rank of the entry in the run that first saw it; it orders entries which share `seen_at`.
HISTORY = ("category STRING, fingerprint STRING, seen_at TIMESTAMP, pos BIGINT")

MESSAGE = ("report_id STRING, title STRING, description STRING, color INT")

# A block's text with its parts: plain text, then the link with its marks.
RUN = "STRUCT<text: STRING, link: STRING, bold: BOOLEAN, italic: BOOLEAN, color: STRING>"
BLOCK = f"report_id STRING, pos INT, type STRING, color STRING, text STRING, link STRING, runs ARRAY<{RUN}>"
