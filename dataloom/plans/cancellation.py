"""Cancellation of a run: cooperative between its rounds, immediate for the jobs under way."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Cancelled(Exception):
    """The run was asked to stop and has published nothing since its last whole round."""


class Cancellation:
    """Asked for from any thread; the run's jobs have a tag by which they are interrupted."""

    def __init__(self, spark: SparkSession):
        self._context, self.tag, self._asked = spark.sparkContext, f"run-{uuid.uuid4().hex}", threading.Event()

    @property
    def requested(self) -> bool:
        return self._asked.is_set()

    def request(self) -> None:
        self._asked.set()
        self._context.cancelJobsWithTag(self.tag)

    def check(self) -> None:
        if self.requested:
            raise Cancelled

    @contextmanager
    def running(self) -> Iterator[None]:
        """What this thread runs inside can be interrupted; a job that ends by that is `Cancelled`."""
        self._context.addJobTag(self.tag)
        try:
            self.check()
            yield
        except Cancelled:
            raise
        except Exception as problem:
            if self.requested:
                raise Cancelled from problem
            raise
        finally:
            self._context.removeJobTag(self.tag)
