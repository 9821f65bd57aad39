"""Who may run a content: markers that one of several writers can create.

A claim is a file named after the content and a number. Its text holds the time until which it counts; after that
another writer may create the next number, which again only one can. So a run that died loses what it
held, and two uploads at once never run one content twice.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import SparkSession

from duebook.sources.tables import _file_system, create_once, read_small


class Claims:
    """Claims in a folder of their own, one small file each; ``lease`` is how long one counts."""

    def __init__(self, spark: SparkSession, path: str, lease: dt.timedelta = dt.timedelta(hours=6)):
        self.spark, self.path, self.lease = spark, path.rstrip("/"), lease

    def _numbers(self, name: str) -> list[int]:
        pattern, fs = _file_system(self.spark, f"{self.path}/{name}.*")
        found = [status.getPath().getName().split(".") for status in (fs.globStatus(pattern) or [])]
        return sorted(int(parts[1]) for parts in found if len(parts) == 2 and parts[1].isdigit())

    def held(self, name: str, now: dt.datetime) -> bool:
        """Whether a claim of somebody counts at a time."""
        numbers = self._numbers(name)
        if not numbers:
            return False
        text = json.loads(read_small(self.spark, f"{self.path}/{name}.{numbers[-1]}"))
        return now < dt.datetime.fromisoformat(text["until"])

    def take(self, name: str, owner: str, now: dt.datetime) -> bool:
        """Claim a content; false if someone else holds it or was faster."""
        numbers = self._numbers(name)
        if numbers and self.held(name, now):
            return False
        text = json.dumps({"owner": owner, "until": (now + self.lease).isoformat()})
        return create_once(self.spark, f"{self.path}/{name}.{numbers[-1] + 1 if numbers else 0}", text)

    def release(self, name: str) -> None:
        """Give a claim up, so that the content may be claimed again at once."""
        for number in self._numbers(name):
            file, fs = _file_system(self.spark, f"{self.path}/{name}.{number}")
            fs.delete(file, False)

    def next_number(self, after: int = 0) -> int:
        """A job number that nobody else is given, larger than ``after`` and than all numbers given before."""
        number = max([after, *self._numbers("job")]) + 1
        while not create_once(self.spark, f"{self.path}/job.{number}", ""):
            number += 1
        return number
