"""Explicit schemas of the data model; nothing is ever inferred from JSON."""

from __future__ import annotations

EVENT = "protocol int, t int, ts double, action string, params string, status string, cost int, budget_remaining map<string,double>, observation string, obs_summary string, error string, message string, run_id string, span_id string, sandbox_id string"
SPAN_EVENTS = "run_id string, span_id string, sandbox_id string, t int, ts double, action string, status string, cost int, event_uri string, observation string, protocol int"
SPAN_INDEX = "span_id string, t int, event_uri string, action string, status string"
RUNS = "run_id string, task_id string, seed int, backend string, created_at double"
STATES = "state_id string, run_id string, parent_state_id string, from_span_id string, t int, backend string, snapshot_uri string, prompt_uri string, budget map<string,double>, created_at double"
SPANS = "span_id string, run_id string, from_state_id string, to_state_id string, sandbox_id string, t_start int, t_end int, created_at double"
METADATA = "state_id string, run_id string, backend string, task_id string, seed int, t int, protocol int"
EPISODE = f"task_id string, seed int, t int, done boolean, result string, budget map<string,double>, rows array<struct<{EVENT.replace(' ', ':').replace(',:', ',')}>>"
PROMPT = "system string, transcript array<struct<role:string,content:string>>"
BLOCKS = "disk string, idx long, data binary"
#: The version of events, and where a run may be executed.
PROTOCOL = 1
BACKENDS = ("episode", "firecracker")
