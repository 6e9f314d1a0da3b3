"""Job parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

OUTPUT_MODES = ("append", "complete", "update")
SUBSCRIBE_MODES = ("assign", "subscribe", "subscribePattern")


@dataclass(frozen=True)
class JobParams:
    # The defaults of the settings a job may be given.
    alert_threshold: float = 10
    output_mode: str = "complete"
    watermark: str = "60 minutes"
    window: str = "60 minutes"
    slide: str = "60 minutes"
    trigger: str | None = "0 seconds"  # None: what is there, then stop
    subscribe_mode: str = "subscribe"
    starting_offsets: str = "earliest"
    max_offsets_per_trigger: int | None = 50000
    output_topic: str = "default"
    shuffle_partitions: int = 100
    # Where messages are.
    bootstrap_servers: str = "localhost:9999"
    topics: str | None = None
    log_path: str | None = None  # a log in files (``sources.file_log``) in place of the broker
    # Further options of the message log, such as security settings, for source and sink.
    extra: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.output_mode.lower() not in OUTPUT_MODES:
            raise ValueError(f"output mode {self.output_mode!r} is none of {', '.join(OUTPUT_MODES)}")
        if self.subscribe_mode not in SUBSCRIBE_MODES:
            raise ValueError(f"subscribe mode {self.subscribe_mode!r} is none of {', '.join(SUBSCRIBE_MODES)}")
