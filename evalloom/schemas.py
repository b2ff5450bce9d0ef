"""Schemas, as DDL texts for spark.read.schema, of the records that are read and written. Names and types are those of the artifacts."""

from __future__ import annotations

_QUESTION = "question:string,answer:string,question_type:string,question_family:string,dimension:string,anchor_kind:string,anchor_ids:array<string>,anchor_labels:array<string>,primary_object:string"
_CLIP = (
    "clip_id string, group_id string, engine string, scene_id string, room_bucket string, motion_family string, trajectory string, direction string, variation_tag string, radius double, "
    "start_angle_offset double, cycle_count int, video_path string, output_dir string, quality_score double"
)
_ASKED = "question string, ground_truth string, question_type string, question_family string, dimension string, anchor_kind string, anchor_ids array<string>, anchor_labels array<string>"
_SCORED = "prediction string, prediction_parse double, ground_truth_parse double, prediction_parse_success boolean, MRA double, `MRA:.5:.95:.05` double, CAPE double"


def _struct(columns: str) -> str:
    """Top-level DDL columns as the inside of a struct type."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(columns + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, kind = columns[start:i].strip().rsplit(" ", 1)
            parts.append(f"{name}:{kind}")
            start = i + 1
    return "struct<" + ",".join(parts) + ">"


MULTIVIEW = (
    "image_id string, image_path string, object_type string, object_id string, scene_id string, object_of_interest_id string, move_pattern string, camera_pitch_action string, agent_position string, "
    "field_of_view int, camera_pitch_degree int, agent_rotation int, pose_index int, num_objects_visible int, trajectory_id string, num_views_in_trajectory int, all_view_paths array<string>, "
    "qa_pairs array<struct<question:string,answer:string,question_type:string,question_id:string,primary_object:string>>"
)
CLIP = f"{_CLIP}, {_ASKED}"
NESTED_QA = f"{_CLIP}, questions array<struct<{_QUESTION}>>"
GROUP = (
    "group_id string, engine string, scene_id string, room_bucket string, motion_family string, question_type string, question_family string, dimension string, radius double, anchor_kind string, "
    "anchor_ids array<string>, anchor_labels array<string>, shared_ground_truth string, clip_ids array<string>, target_group_size int, selected_group_size int"
)
IMAGE_GROUP = "group_id string, engine string, scene_id string, question_type string, question_family string, anchor_ids array<string>, anchor_labels array<string>, image_ids array<string>, images_selected int"
HIGHER_ORDER = "constraint_id string, constraint_row_index int, constraint_dimension string, higher_order_analysis string, prediction_parse double, ground_truth_parse double, prediction_parse_success boolean"
SCENE_VARIATION = (
    "image_path string, question string, ground_truth string, question_type string, edit_type string, scene_name string, image_id string, original_image_path string, question_id string, primary_object string, "
    "group_id string, translation_direction string, scene_edit_id string, camera_id string, translation_distance double, anchor_labels array<string>, anchor_kind string, dimension string"
)
CANDIDATE = (
    "group_id string, scene_id string, question string, ground_truth string, question_type string, question_family string, anchor_ids array<string>, anchor_labels array<string>, "
    "available_clips array<struct<trajectory:string,direction:string,variation_tag:string,radius:double,start_angle_offset:double,cycle_count:int,quality_score:double>>"
)
SCAN = (
    "scene_id string, room_bucket string, eye_y double, objects map<string,struct<object_type:string,object_position:array<double>,centroid_xz:array<double>,centroid_height:double,obj_radius:double,"
    "buckets:map<string,array<struct<pos:array<double>,angle:double,distance:double>>>>>"
)
VISIBILITY = "anchor_ids array<string>, frames map<string,array<string>>"
CONVERSATION = "video string, image string, conversations array<struct<`from`:string,value:string>>"
RESULTS = "results map<string,map<string,map<string,double>>>, configs map<string,string>, model_name string"


def scored(field: str) -> str:
    """Scored samples: the document with its prediction and metrics in the struct ``field``, under which the harness at hand writes it."""
    return f"doc_id bigint, filtered_resps array<string>, `{field}` {_struct(f'{_CLIP}, {_ASKED}, edit_type string, {_SCORED}')}"
