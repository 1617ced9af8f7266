"""Schemas of the datasets that are read, as Spark DDL. Open fields are VARIANT."""

MESSAGE = "struct<role:string,content:string,name:string,reasoning:string>"
AXES = "map<string,string>"
METADATA = "struct<source:string,quality_status:string,scenario_family:string,group_id:string,perturbation_of:string,perturbation_kind:string,author:string,created_at:string,notes:string>"
EXAMPLE = f"id string, version string, task string, domain string, messages array<{MESSAGE}>, variation_axes {AXES}, metadata {METADATA}"
EVALUATION = f"id string, version string, task string, messages array<{MESSAGE}>, variation_axes {AXES}, metadata {METADATA}, reference variant, grader string, split_tag string, ood_shift string"
RECORD = (
    "example_id string, task string, arm string, seed int, score double, grader string, sub_scores map<string,double>, split_tag string, ood_shift string, scenario_family string, perturbation_kind string, "
    "decision string, reference_decision string, latency_seconds double, prompt_tokens int, completion_tokens int, parse_failed boolean, had_reasoning boolean, group_id string, subset string, finish_reason string, details variant, response string, reasoning string"
)
MANIFEST = (
    "version string, schema_version string, preprocessing_version string, created_at string, source string, description string, example_count bigint, splits map<string,bigint>, task_distribution map<string,bigint>, domain_distribution map<string,bigint>, "
    "source_distribution map<string,bigint>, quality_distribution map<string,bigint>, split_strategy string, split_seed bigint, holdout_values array<string>, file_hashes map<string,string>, content_hash string, contains_private_data boolean, notes string"
)
RUN = "experiment_id string, name string, kind string, status string, task string, model_family string, config_hash string, seed bigint, dataset_version string, dataset_hash string, created_at string, started_at string, finished_at string, duration_seconds double, metrics variant"
EVENT = "ts double, iso_time string, experiment_id string, stage string, event string"
GENERATION = "seed int, example_id string, text string, reasoning string, prompt_tokens int, completion_tokens int, finish_reason string, latency_seconds double"
#: The fields of a record that a payload's results hold, for use inside of a struct.
RECORD_FIELDS = ", ".join(f"{name}: {kind}" for name, kind in (x.split(" ", 1) for x in RECORD.split(", ")))
