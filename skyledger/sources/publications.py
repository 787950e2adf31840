"""Which run's marts are the ones to read.

Every refresh writes to a folder of its own and then publishes it by one small file,
``published/<number>.json``, which names the run of every mart. Its number is one more than
that of the publication it follows, and creating it fails if another refresh has taken
the number. So publications are a sequence, each says what it was built on, and a
reader follows the last one.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from skyledger.sources import files
from skyledger.sources.buckets import BUCKETED_MARTS

# Folders of which every run has one of its own, beside the publications.
RUNS, PARTIALS, LEDGERS = "runs", "partials", "ledgers"


@dataclass(frozen=True)
class Publication:
    """The run of each mart; and, of an incremental refresh, its partial sums and ledger.

    The paths are relative to the folder of the marts. ``buckets``: into how many a mart is
    divided, of those that are.
    """

    number: int = 0
    marts: Mapping[str, str] = field(default_factory=dict)
    buckets: Mapping[str, int] = field(default_factory=dict)
    partials: tuple[str, ...] = ()
    ledger: str | None = None

    def paths(self) -> set[str]:
        return {*self.marts.values(), *self.partials, *([self.ledger] if self.ledger else [])}


class OvertakenError(RuntimeError):
    """Another refresh has published in the meantime."""


def _file(folder: str, number: int) -> str:
    return f"{folder}/published/{number:010d}.json"


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    names = [e.name for e in files.entries(spark, f"{folder}/published")]
    return sorted(int(name[:-5]) for name in names if re.fullmatch(r"\d+\.json", name))


def _read(spark: SparkSession, folder: str, number: int) -> Publication:
    found = json.loads(files.read_text(spark, _file(folder, number)))
    return Publication(number, found["marts"], found["buckets"], tuple(found["partials"]), found["ledger"])


def latest(spark: SparkSession, folder: str) -> Publication:
    """The last publication; number 0 and no marts if there is none."""
    numbers = _numbers(spark, folder)
    return _read(spark, folder, numbers[-1]) if numbers else Publication()


def publish(spark: SparkSession, folder: str, after: Publication, new: Publication) -> Publication:
    """Publish ``new`` right after ``after``, or raise that another refresh was first."""
    new = replace(new, number=after.number + 1)
    text = json.dumps(
        {"marts": dict(new.marts), "buckets": dict(new.buckets), "partials": list(new.partials), "ledger": new.ledger}, indent=1
    )
    if not files.create_if_absent(spark, _file(folder, new.number), text):
        raise OvertakenError(f"publication {new.number} of {folder} is another refresh's")
    return new


def followed_by(last: Publication, marts: Mapping[str, str], buckets: int | None = None) -> Publication:
    """``last`` with these marts in the place of its own; it has no ledger or partial sums."""
    divided = {name: n for name, n in last.buckets.items() if name not in marts}
    divided |= {name: buckets for name in marts if buckets and name in BUCKETED_MARTS}
    return Publication(marts={**last.marts, **marts}, buckets=divided)


def publish_marts(
    spark: SparkSession, folder: str, marts: Mapping[str, str], buckets: int | None = None
) -> Publication:
    """Publish these marts over whatever is the last publication, keeping its others.

    What they were not built on goes: a ledger and partial sums speak of other marts.
    """
    while True:
        last = latest(spark, folder)
        try:
            return publish(spark, folder, last, followed_by(last, marts, buckets))
        except OvertakenError:
            continue


def clear_old_runs(spark: SparkSession, folder: str, keep: int = 2, hours: float = 24.0) -> list[str]:
    """Delete what only publications before the last ``keep`` refer to; returns the paths.

    What is younger than ``hours`` stays: it may be a refresh that has not published yet,
    or be read by someone who has just opened it.
    """
    if keep < 1:
        raise ValueError("the last publication is always kept")
    numbers = _numbers(spark, folder)
    kept = [_read(spark, folder, n) for n in numbers[-keep:]]
    needed = set().union(*(p.paths() for p in kept))
    before = time.time() - hours * 3600
    gone = [
        f"{place}/{entry.name}"
        for place in (RUNS, PARTIALS, LEDGERS)
        for entry in files.entries(spark, f"{folder}/{place}")
        if f"{place}/{entry.name}" not in needed and entry.modified <= before
    ]
    old = [
        f"published/{entry.name}"
        for entry in files.entries(spark, f"{folder}/published")
        if entry.modified <= before
        and (entry.name.startswith(".") or entry.name in {f"{n:010d}.json" for n in numbers[:-keep]})
    ]
    # Publications first: none may point to what is gone.
    for path in [*old, *gone]:
        files.remove(spark, f"{folder}/{path}")
    return [*old, *gone]
