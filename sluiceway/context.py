"""Identity of one job run."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date, datetime, timezone

_ISO_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


def iso_date(text: str) -> str:
    """Return ``text`` if it is a calendar date written YYYY-MM-DD, else raise."""
    if not _ISO_DATE.fullmatch(text):
        raise ValueError(f"ds must be a date written YYYY-MM-DD, got {text!r}")
    date.fromisoformat(text)
    return text


@dataclass(frozen=True)
class RunContext:
    domain: str
    group_name: str
    item_name: str
    run_id: str
    ds: str
    ingest_ts: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    def __post_init__(self) -> None:
        iso_date(self.ds)

    @classmethod
    def from_args(
        cls, domain: str, group_name: str, item_name: str, args: Mapping[str, str]
    ) -> RunContext:
        """Build a context; ``run_id`` defaults to a fresh UUID and ``ds`` to today."""
        return cls(
            domain=domain,
            group_name=group_name,
            item_name=item_name,
            run_id=args.get("run_id") or str(uuid.uuid4()),
            ds=args.get("ds") or date.today().isoformat(),
        )
