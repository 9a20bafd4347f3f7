"""Declared schemas of the files that are read; nothing is inferred."""

from __future__ import annotations

SENSOR_CORE = "time_stamp string, asset_id string, id string, train_test string, status_type_id string"
EVENT_INFO = "asset string, event_id string, event_label string, event_start string, event_start_id string, event_end string, event_end_id string, event_description string"
COCO = (
    "images array<struct<id: int, file_name: string, width: int, height: int>>, "
    "annotations array<struct<id: bigint, image_id: int, category_id: int, bbox: array<double>, area: double>>, "
    "categories array<struct<id: int, name: string>>"
)
GOLD_LINE = "query_id string, query_text string, relevant_chunk_ids array<string>"
CASES = "id string, scada_case struct<window_id: string, summary: string, tags: array<string>>, mechanic_notes string, fault_images_description string, gold_chunk_ids array<string>"
LABEL_RESULT = "filename string, gold_labels array<string>, pred_labels array<string>"
PAYLOAD = "window_id string, baseline_hours int, window_hours int, csv_sep string, csv string, meta map<string, string>"
CARD = (
    "window_id string, source struct<source: string, dataset_id: int, asset_id: int, window_end: string, event_label: string, event_description: string>, "
    "window struct<end_time: string, start_time: string, row_count: int, baseline_hours: int, window_hours: int>, stats map<string, double>, "
    "derived struct<power_residual_mean: double, power_residual_std: double, status_10min_interval_counts: map<string, bigint>, status_legend: map<string, string>>, "
    "tags array<string>, summary string"
)
