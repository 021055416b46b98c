"""Domains, dimension tables and struct types of the document model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the document model: enumerations, and the weights and orders of its rules.
REGION_TYPES = ("text", "table", "image", "header", "footer", "title", "paragraph", "list", "caption", "sidebar", "other")
TEXT_REGIONS = ("text", "title", "header", "footer", "caption")
CONTENT_TYPES = ("text_paragraph", "text_title", "text_header", "text_footer", "text_list", "text_caption", "table_structured", "image_reference")
ENTITY_TYPES = ("person", "organization", "location", "date", "product", "concept", "numeric", "event", "technology", "document", "other")
RELATION_TYPES = (
    "is_a", "part_of", "located_in", "works_for", "created_by", "contains", "related_to", "temporal", "causal", "member_of", "instance_of",
    "similar_to", "depends_on", "used_by", "owns", "affects", "precedes", "follows", "composed_of", "produces", "other",
)
CELL_TYPES = ("header", "data", "footer", "merged", "empty")
CONDITIONS = (
    "skewed", "rotated_90_cw", "rotated_90_ccw", "rotated_180", "poor_quality", "blurry", "low_contrast", "dark_background", "faded_text",
    "shadow_distortion", "torn_edges", "watermarked", "scanned_from_copy", "handwritten", "mixed_handwritten_typed", "multi_column", "complex_layout",
)
ACTIONS = (
    "no_action", "deskew", "rotate_90_cw", "rotate_90_ccw", "rotate_180", "enhance_contrast", "denoise", "sharpen", "binarize", "remove_shadows",
    "crop_margins", "straighten_perspective", "adaptive_threshold", "gamma_correction", "histogram_equalization",
)
SEVERITIES = ("none", "mild", "moderate", "severe", "critical")
SEVERITY_IMPACT = {"none": 0.0, "mild": 0.03, "moderate": 0.12, "severe": 0.25, "critical": 0.45}
CONDITION_MODIFIER = {
    "rotated_180": 0.8, "rotated_90_cw": 0.8, "rotated_90_ccw": 0.8, "skewed": 0.9, "handwritten": 1.2, "poor_quality": 1.1, "blurry": 1.3,
    "low_contrast": 1.0, "shadow_distortion": 1.1,
}
SECONDARY_WEIGHT, IMPACT_CAP, SUCCESS_FLOOR = 0.6, 0.7, 0.25
ROTATIONS = ("rotated_180", "rotated_90_ccw", "rotated_90_cw")  # in order of precedence; "skewed" comes last
ACTION_RANK = {
    "rotate_180": 1, "rotate_90_cw": 2, "rotate_90_ccw": 2, "deskew": 3, "straighten_perspective": 4, "crop_margins": 5, "remove_shadows": 6,
    "enhance_contrast": 7, "gamma_correction": 8, "histogram_equalization": 9, "denoise": 10, "sharpen": 11, "adaptive_threshold": 12, "binarize": 13,
}
ACTION_GROUP = {
    "rotate_180": 1, "rotate_90_cw": 1, "rotate_90_ccw": 1, "deskew": 2, "straighten_perspective": 2, "crop_margins": 3, "remove_shadows": 4,
    "enhance_contrast": 5, "gamma_correction": 5, "histogram_equalization": 5, "denoise": 6, "sharpen": 7, "binarize": 8, "adaptive_threshold": 8,
}
UPSIDE_DOWN = ("upside down", "bottom", "header", "letterhead", "signature", "footer", "page number", "inverted")
HORIZONTAL = ("horizontal", "left to right", "line", "paragraph", "text line")
DETECTION_LABELS = ("table", "table column", "table row", "table column header", "table projected row header", "table spanning cell")
SYMBOLS = (("✓", "[CE_MARK]"), ("Δ", "[DELTA]"), ("Ra", "[ROUGHNESS_Ra]"))
DOCUMENT_CLASSES = ("Technical Manual", "Purchase Order", "Financial Report", "Contract", "Conference Paper", "Other")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".tiff")
QUALITY_ISSUES = {"low_contrast": ("low_contrast", "enhance_contrast"), "dark_image": ("dark_background", "gamma_correction"), "blurry_image": ("blurry", "sharpen"), "noisy_image": ("poor_quality", "denoise")}
PRESETS = {
    "intermediate": ("enhance_contrast", "denoise", "sharpen", "crop_margins"),
    "advanced": ("deskew", "enhance_contrast", "remove_shadows", "denoise", "sharpen", "adaptive_threshold", "crop_margins"),
}
NOTES = {
    "handwritten": "Contains handwritten content - may require specialized OCR settings",
    "multi_column": "Multi-column layout detected - consider column-aware processing",
    "complex_layout": "Complex layout detected - may require manual verification",
}
TURN_NOTE, TURN_NAMES = "Rotation correction needed: ", {"rotated_90_cw": "90° CW", "rotated_90_ccw": "90° CCW", "rotated_180": "180°"}
QUALITY_NOTE, GOOD_NOTE = "Multiple quality issues detected - may require careful preprocessing", "Document appears to be in good condition"
FALLBACK_TABLE = (("Parameter", "Value"), ("Extraction Failed", "Unable to parse table"))
FAILED_QUALITY = "Unable to assess - analysis failed"
QUALITY_EVIDENCE = {
    "low_contrast": "Low contrast detected (score: %s)",
    "dark_image": "Dark background detected (score: %s)",
    "blurry_image": "Blur detected (sharpness score: %s)",
    "noisy_image": "High noise level detected (level: %s)",
}
TYPE_COLOURS = {
    "text": "#2E86C1", "table": "#E74C3C", "image": "#27AE60", "header": "#8E44AD", "footer": "#F39C12", "title": "#C0392B", "caption": "#16A085", "sidebar": "#7D3C98", "other": "#95A5A6",
}

BBOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "width", "height")])
REGION = T.StructType(
    [
        T.StructField("region_id", T.StringType()), T.StructField("region_type", T.StringType()), T.StructField("bbox", BBOX), T.StructField("confidence", T.DoubleType()),
        T.StructField("content_description", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("reading_order", T.IntegerType()),
    ]
)
LAYOUT = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("regions", T.ArrayType(REGION)), T.StructField("total_regions", T.IntegerType())])
CELL = T.StructType(
    [
        T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("rowspan", T.IntegerType()),
        T.StructField("colspan", T.IntegerType()), T.StructField("cell_type", T.StringType()), T.StructField("confidence", T.DoubleType()),
    ]
)
RELATIONSHIP = T.StructType([T.StructField("row_header", T.StringType()), T.StructField("values", T.MapType(T.StringType(), T.StringType())), T.StructField("single_value", T.StringType()), T.StructField("row_notes", T.StringType())])
SEMANTIC_TABLE = T.StructType(
    [
        T.StructField("table_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("table_type", T.StringType()),
        T.StructField("structure", T.StructType([T.StructField("rows", T.IntegerType()), T.StructField("columns", T.IntegerType()), T.StructField("has_row_headers", T.BooleanType()), T.StructField("has_column_headers", T.BooleanType()), T.StructField("header_levels", T.IntegerType())])),
        T.StructField("headers", T.StructType([T.StructField("row_headers", T.ArrayType(T.StringType())), T.StructField("column_headers", T.ArrayType(T.StringType()))])),
        T.StructField("data_relationships", T.ArrayType(RELATIONSHIP)), T.StructField("notes", T.StringType()),
    ]
)
SEMANTIC_RESULT = T.StructType(
    [
        T.StructField("table_summary", T.StructType([T.StructField("total_tables", T.IntegerType()), T.StructField("main_topic", T.StringType()), T.StructField("document_type", T.StringType())])),
        T.StructField("tables", T.ArrayType(SEMANTIC_TABLE)),
        T.StructField("extraction_metadata", T.StructType([T.StructField("confidence", T.DoubleType()), T.StructField("detected_language", T.StringType()), T.StructField("data_types", T.ArrayType(T.StringType())), T.StructField("complexity_level", T.StringType())])),
    ]
)
SAVED_RESPONSE = T.StructType([T.StructField("extraction_timestamp", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("raw_semantic_result", SEMANTIC_RESULT)])
ENTITY = T.StructType([T.StructField("name", T.StringType()), T.StructField("entity_type", T.StringType()), T.StructField("aliases", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType()), T.StructField("source_text", T.StringType())])
TRIPLET = T.StructType([T.StructField("subject", ENTITY), T.StructField("predicate", T.StringType()), T.StructField("object", ENTITY), T.StructField("confidence", T.DoubleType()), T.StructField("source_sentence", T.StringType()), T.StructField("page_number", T.IntegerType())])
INSIGHT = T.StructType([T.StructField("insight_type", T.StringType()), T.StructField("subject", T.StringType()), T.StructField("description", T.StringType()), T.StructField("data_points", T.ArrayType(T.StringType()))])
# Declared only: contracts of outputs that nothing computes in full.
CROSS_PAGE_CONTENT = T.StructType([T.StructField("content_ids", T.ArrayType(T.StringType())), T.StructField("merged_content", T.StringType()), T.StructField("start_page", T.IntegerType()), T.StructField("end_page", T.IntegerType()), T.StructField("merge_confidence", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StringType()))])
STAGE_RESULT = T.StructType([T.StructField("stage", T.StringType()), T.StructField("status", T.StringType()), T.StructField("start_time", T.TimestampType()), T.StructField("end_time", T.TimestampType()), T.StructField("duration", T.DoubleType()), T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType()))])
