"""Schemas of the stored rows, as Spark DDL."""

ROAD = (
    "struct<highway:string,name:string,ref:string,maxspeed:string,lanes:int,surface:string,"
    "oneway:boolean,lit:boolean,bridge:boolean,tunnel:boolean,toll:boolean,street_names:array<string>>"
)
SAMPLE = (
    "id string, route_id string, step_index int, dataset_version string, split string, maneuver string, "
    "prior struct<instruction:string>, images struct<overhead:string,frames:array<string>,dashcam:string>, "
    "geometry struct<step_polyline:string,start_lat:double,start_lng:double,end_lat:double,end_lng:double,heading:double>, "
    "distances struct<step_distance_m:double,remaining_distance_m:double>, "
    f"osm_road {ROAD}, metadata struct<source:string,created_at:string>"
)
RESULT = (
    "id string, sample_id string, model_id string, modality string, variant string, augment string, "
    "provider string, label_version string, enhanced_instruction string, lane_change_required string, "
    "lanes_count int, next_action string, relevant_landmarks array<string>, potential_hazards array<string>, "
    "spatial_landmarks struct<left:array<string>,center:array<string>,right:array<string>>, "
    "reasoning string, lane_hint string, confidence double, fallback_reason string, "
    "inference_metadata struct<latency_ms:int,tokens_in:int,tokens_out:int,tokens_reasoning:int,timestamp:string,"
    "prompt_meta:struct<text_prompt:string,frame_paths:array<string>,overhead_path:string,num_images_sent:int,"
    "system_prompt:string>>, error string, raw_response string"
)
GROUND_TRUTH = (
    "sample_id string, is_auto boolean, result_key string, instruction string, acceptable_actions array<string>"
)
FRAME = (
    "struct<filename:string,distance_into_step_m:int,remaining_m:int,pano_id:string,lat:double,lng:double,"
    "heading:double,pitch:int,fov:int,size:string>"
)
STEP = (
    "struct<step_index:int,maneuver:string,instruction:string,polyline:string,distance_m:int,start_lat:double,"
    f"start_lng:double,end_lat:double,end_lng:double,heading:double,frames:array<{FRAME}>,frame:{FRAME},"
    f"sparse4_frames:array<{FRAME}>>"
)
MANIFEST_ROUTE = f"route_id string, city string, part bigint, steps_count bigint, frames_count bigint, steps array<{STEP}>"
MANIFEST = (
    "version string, name string, created_at string, "
    f"routes array<struct<route_id:string,city:string,total_distance_m:int,total_duration_s:int,steps:array<{STEP}>>>"
)
REGISTRY = (
    "models array<struct<display_name:string,model_id:string,aliases:array<string>,provider:string,params_b:double,"
    "params_estimated:string,active_params_b:double,is_moe:boolean,release_date:string,"
    "input_cost_per_mtok:double,output_cost_per_mtok:double>>"
)
SPLITS = "train array<string>, val array<string>, test array<string>"
ASSIGNMENT = "version string, strategy string, assignments map<string,string>"
