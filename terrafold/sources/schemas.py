"""Schemas of the stored tables and exchange files."""

SCENES = (
    "scene_id string, sensor string, modality string, acquisition_time timestamp, geometry_wkt string, "
    "file_path string, cloud_cover double, object string, paired_scene_id string, dataset_origin string"
)
SCENES_WITH_BANDS = SCENES + ", wavelengths_nm string"
QUERY_LOG = (
    "query_text string, task_type string, location string, "
    "aoi struct<type: string, coordinates: array<array<array<double>>>>, start_date timestamp, end_date timestamp, "
    "sensor string, object string, event string, change_flag boolean, question string, referring_expression string, "
    "confidence double, used_fallback boolean, image_id string"
)
RESULTS = (
    "image_id string, rank int, score double, score_breakdown struct<semantic_sim: double, geo_score: double, "
    "temporal_score: double, modality_score: double, change_score: double>, metadata map<string,string>, "
    "model_outputs struct<caption: string, vqa_answer: string, change_description: string, fusion_statement: string, "
    "grounding_bbox: array<double>>, explanation_text string, confidence_note string"
)
BITEMPORAL_SIDE = (
    "struct<sensor: string, modality: string, geometry_wkt: string, file_path: string, cloud_cover: double, object: string>"
)
BITEMPORAL = f"t1 {BITEMPORAL_SIDE}, t2 {BITEMPORAL_SIDE}, qa struct<question: string, answer: string>"
STAC_ITEM = (
    "scene_id string, collection string, datetime string, bbox array<double>, assets array<string>, "
    "signed_href string, local_image string, properties map<string,string>"
)
PATCH_LABELS = "labels array<string>, tile_id string"
EVAL_RUN = (
    "metrics struct<`recall@5`: double, `precision@5`: double, `map@5`: double>, "
    "cosine_similarity struct<mean: double, std: double, min: double, max: double>, "
    "latency_ms struct<p50: double, p95: double, mean: double>, num_queries int, num_test_scenes int, "
    "date timestamp, tag string"
)
