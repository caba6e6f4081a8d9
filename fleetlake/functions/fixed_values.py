"""Fixed values the results depend on.

FIXED VALUES: the texts, maps and thresholds below must equal the original
application's for the outputs to match; they are stated here as plain data,
in their natural order, and nowhere else in the package.
"""

from __future__ import annotations

# --- FIXED VALUES: silver root-cause text by failure category ---------------
ROOT_CAUSE_BY_CATEGORY: dict[str, str] = {
    "none": "Healthy pipeline execution",
    "executor_oom": "Memory pressure on wide Spark feature extraction stage",
    "skewed_shuffle": "Uneven partition distribution causing shuffle skew",
    "metadata_timeout": "Control-plane timeout during catalog or manifest access",
    "hot_partition": "A single hot partition dominated merge throughput",
    "queue_saturation": "Shared compute pool was saturated during production traffic",
    "late_input_arrival": "Upstream landing delay compressed the batch window",
}

# --- FIXED VALUES: silver recommended action by failure category ------------
ACTION_BY_CATEGORY: dict[str, str] = {
    "none": "No action required; continue normal monitoring.",
    "executor_oom": "Increase executor memory for the hot stage, rebalance partitions, and re-run the failed slice.",
    "skewed_shuffle": "Salt the skewed key, raise shuffle partitions, and backfill the worst partition range.",
    "metadata_timeout": "Retry against a warm catalog replica and stagger metadata-heavy jobs away from the publish window.",
    "hot_partition": "Compact the hotspot partition, split the merge scope, and validate downstream reads before reopening traffic.",
    "queue_saturation": "Move the workload to a reserved pool and shift the low-priority jobs out of the same window.",
    "late_input_arrival": "Trigger the upstream ingest catch-up flow and run only the delayed partition before the full refresh.",
}

# --- FIXED VALUES: user impact text by failure category ---------------------
USER_IMPACT_BY_CATEGORY: dict[str, str] = {
    "none": "Healthy run; no customer intervention required.",
    "executor_oom": "Feature refresh delayed; agent recommendations are partially stale.",
    "skewed_shuffle": "Cluster runtime expanded and the SLA window is at risk.",
    "metadata_timeout": "Downstream publish paused while metastore retries cleared.",
    "hot_partition": "One dataset partition is dominating runtime and causing retries.",
    "queue_saturation": "Shared cluster is saturated; customer dashboards may lag.",
    "late_input_arrival": "Upstream ingest landed late and compressed the processing window.",
}

# --- FIXED VALUES: severity order and status penalty ------------------------
SEVERITY_RANK: dict[str, int] = {"high": 0, "medium": 1, "low": 2}
SEVERITY_RANK_OTHER = 3
STATUS_PENALTY: dict[str, int] = {"success": 0, "degraded": 12, "failed": 28}

# --- FIXED VALUES: triage runbook library ------------------------------------
RUNBOOK_LIBRARY: dict[str, dict[str, object]] = {
    "executor_oom": {
        "root_cause": "Executor memory was undersized for a wide join and the spill curve climbed sharply.",
        "actions": [
            "Pin the workload to a higher-memory executor profile for the next run.",
            "Increase shuffle partitions before the feature join to reduce per-task peak memory.",
            "Replay only the failed partition window instead of reprocessing the full batch.",
        ],
        "deployment": [
            "Update the workload config in staging with the higher-memory profile.",
            "Validate spill and retry metrics on one replay partition.",
            "Promote the config to production and keep the reserved queue warm for the next scheduled run.",
        ],
    },
    "skewed_shuffle": {
        "root_cause": "One or two keys are dominating partition sizes and forcing large shuffle retries.",
        "actions": [
            "Salt the hot key and raise shuffle partition count for this workload.",
            "Backfill the heaviest partition range first to unblock downstream freshness.",
            "Capture a skew snapshot so the customer team can see exactly which dimension exploded.",
        ],
        "deployment": [
            "Apply key salting behind a feature flag in staging.",
            "Run a targeted replay against the skewed date range.",
            "Promote the change once shuffle skew and task retry counts normalize.",
        ],
    },
    "metadata_timeout": {
        "root_cause": "The workload stalled on control-plane metadata calls during publish or manifest reads.",
        "actions": [
            "Retry against a warm metastore replica and move the publish off the busiest minute of the window.",
            "Cache the manifest lookup for repeated read-heavy stages.",
            "Add a stakeholder status note because the pipeline can recover without data loss.",
        ],
        "deployment": [
            "Validate catalog connectivity in staging.",
            "Shift the publish window by 10 minutes and rerun the affected stage.",
            "Deploy the retry configuration and confirm downstream readers reopen cleanly.",
        ],
    },
    "hot_partition": {
        "root_cause": "A single partition or merge key is absorbing disproportionate write pressure.",
        "actions": [
            "Compact the hot partition before the next merge.",
            "Split the write scope into smaller micro-batches for the overloaded partition.",
            "Run a targeted validation on downstream reads before widening the backfill.",
        ],
        "deployment": [
            "Apply the partition split in staging.",
            "Run a micro-batch backfill on the hotspot.",
            "Promote once merge latency and retry counts stabilize.",
        ],
    },
    "queue_saturation": {
        "root_cause": "The workload contended with other production jobs and never acquired enough reserved slots.",
        "actions": [
            "Move the workload to a reserved queue during the customer SLA window.",
            "Shift low-priority backfills out of the same time block.",
            "Keep the customer updated because latency is driven by shared-cluster pressure, not bad data.",
        ],
        "deployment": [
            "Reserve capacity for the workload in staging.",
            "Replay one representative batch to confirm end-to-end runtime.",
            "Promote the schedule and queue policy before the next customer window.",
        ],
    },
    "late_input_arrival": {
        "root_cause": "The upstream ingest landed late and compressed the downstream processing window.",
        "actions": [
            "Trigger the upstream catch-up flow and rerun only the delayed partitions.",
            "Add a freshness guard so the downstream publish waits for the complete landing set.",
            "Flag the upstream dependency in the customer update so ownership is clear.",
        ],
        "deployment": [
            "Patch the freshness guard in staging.",
            "Replay the delayed slice and validate the publish checkpoint.",
            "Roll out the guard before the next scheduled ingest window.",
        ],
    },
    "none": {
        "root_cause": "The pipeline is operating inside the normal performance envelope.",
        "actions": [
            "Keep monitoring the workload and compare next-run latency to the current baseline.",
        ],
        "deployment": [
            "No deployment change is required.",
        ],
    },
}

# --- FIXED VALUES: triage conditional steps and thresholds -------------------
QUEUE_ACTION_THRESHOLD = 12
QUEUE_ACTION = "Keep the workload pinned to reserved capacity until queue depth is back below 8."
MEMORY_ACTION_THRESHOLD = 90
MEMORY_ACTION = "Add a memory profile check to the pre-flight validation for this workload."
OPEN_INCIDENT_DEPLOY_THRESHOLD = 2
OPEN_INCIDENT_DEPLOY_STEP = (
    "Bundle this change with a short customer checkpoint so the recovery plan feels coordinated."
)

# --- FIXED VALUES: queue and feed sizes --------------------------------------
INCIDENT_QUEUE_SIZE = 16
DASHBOARD_INCIDENTS = 14
COMPARABLE_LIMIT = 3
ACTIVITY_FEED_SIZE = 40
PIPELINE_RUNS_SHOWN = 6
AGENT_RUNS_SHOWN = 8
SESSIONS_SHOWN = 25
PROFILE_SAMPLE_ROWS = 5
PREVIEW_ROWS = 10
SUMMARY_TOP = 10

# --- FIXED VALUES: analysis column preferences (keyword order) ---------------
RISK_REQUIRED_COLUMNS = ("account", "workload", "duration_minutes", "sla_minutes")
CATEGORY_PREFERENCES = ["account", "customer", "workload", "region", "team"]
METRIC_PREFERENCES = ["duration", "cost", "error", "retry", "risk", "sla", "spill", "rows"]

# --- FIXED VALUES: text read as missing in uploaded CSV (pandas default list) -
MISSING_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# --- FIXED VALUES: triage step stages, titles and texts ----------------------
TRIAGE_STEPS = [
    ("planner", "Framed the customer issue"),
    ("blast-radius", "Measured customer blast radius"),
    ("history", "Pulled comparable failures"),
    ("runbook", "Built the recovery plan"),
    ("customer-update", "Prepared the stakeholder update"),
]
NO_COMPARABLES_TEXT = "Found no directly comparable incidents in the recent queue."
COMPARABLES_TEXT = "Matched {n} recent incidents with the same failure mode to guide remediation."
REJECT_NO_CUSTOMER = "customer not found"
REJECT_UNKNOWN_CATEGORY = "unknown failure category"
