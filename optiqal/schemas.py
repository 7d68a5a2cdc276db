"""Fixed schemas of the tables that the operators read and write."""

from __future__ import annotations

IMAGES = (
    "asset_id string, filename string, target_path string, width int, height int, asset_url string, tags array<string>, "
    "clip_embeddings array<float>, caption string, is_blurry boolean, is_corrupted boolean, blur_score double, "
    "file_size_bytes bigint, color array<double>, luminance double, contrast double"
)
SHAPES = (
    "filename string, asset_url string, asset_id string, annotation_id string, shape_id string, shape_embeddings array<float>, "
    "label string, label_id string, x double, y double, w double, h double, x_norm double, y_norm double, w_norm double, "
    "h_norm double, image_width int, image_height int"
)
ANNOTATIONS = (
    "asset_id string, annotation_id string, created_at timestamp, task_type string, "
    "shapes array<struct<id: string, label: string, label_id: string, x: double, y: double, w: double, h: double, "
    "coords: array<struct<x: double, y: double>>>>"
)
OUTLIERS = '`group` string, item string, description string, label string, label_2 string, asset_id string, shape_id string, score double'
REPORT = "section string, sub_section string, name string, ordinal int, text string, data_json string, actions array<string>"

TASK_TYPES = ("OBJECT_DETECTION", "SEGMENTATION", "CLASSIFICATION")
ACTIONS = ("DELETE", "CREATE", "UPDATE", "TAG", "CLEAN")
