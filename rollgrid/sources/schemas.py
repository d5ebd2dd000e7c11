"""One explicit schema for each source, as DDL; all fields may be missing."""

METRICS = ["no_at_fault_collisions", "drivable_area_compliance", "ego_progress", "time_to_collision_within_bound", "history_comfort"]


ROLLOUT = (
    "token string, response_length int, parsed_ok boolean, poses array<array<double>>, safe double, training_reward double, pdms double, pdms_scaled double, overall double, "
    + ", ".join(f"{m} double" for m in METRICS)
    + ", reward_latency_ms double"
)
STEP = "step int, sampling struct<generated_groups:int,kept_groups:int,used_groups:int,dropped_groups:int,unused_kept_groups:int,generation_batches:int,raw_rollout_overhead:double>, timing_s struct<step:double>"
PROMPT = "images array<string>, problem string, answer struct<token:string,gt:array<bigint>>"
CHAT = "id string, system string, image array<string>, conversations array<struct<`from`:string,value:string>>"
SCORES = "token string, pdms double, pdms_scaled double"
FRAME = "log_name string, scene_token string, token string, idx int, timestamp long, x double, y double, heading double, roadblock_ids array<string>"
