"""Schemas of the library's tables; readers never infer them."""

from __future__ import annotations

from pyspark.sql.types import StructType, _parse_datatype_string

DDL = {
    "assets": "asset_id string not null, creation_date timestamp, media_type string not null, duration double not null, "
    "pixel_width int not null, pixel_height int not null, burst_id string",
    "asset_resources": "asset_id string not null, file_size bigint",
    "albums": "album_id string not null, title string",
    "album_assets": "album_id string not null, asset_id string not null",
    "feature_index": "asset_id string not null, embedding array<float>, byte_size bigint not null, scanned_at timestamp not null",
    "decision_log": "seq bigint not null, asset_id string, op string not null",
    "review_state": "asset_id string not null, reviewed boolean not null, marked boolean not null",
    "size_cache": "asset_id string not null, bytes bigint not null",
    "delete_log": "seq bigint not null, id string not null, date timestamp not null, count bigint not null, bytes_freed bigint not null",
}


def schema(name: str) -> StructType:
    return _parse_datatype_string(DDL[name])
