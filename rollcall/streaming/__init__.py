from rollcall.streaming.answers import run_answers, run_closed_spans, stream_answers, stream_closed_spans
from rollcall.streaming.jobs import (
    run_alive_spans,
    run_registration_outcomes,
    run_replay,
    stream_last_seen,
)
from rollcall.streaming.sinks import run_folded, run_updates

__all__ = [
    "run_alive_spans",
    "run_answers",
    "run_closed_spans",
    "run_folded",
    "run_registration_outcomes",
    "run_replay",
    "run_updates",
    "stream_answers",
    "stream_closed_spans",
    "stream_last_seen",
]
