"""Named jobs over Spark, run now or in the background."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


class NoSuchProcess(LookupError):
    pass


class NoSuchJob(LookupError):
    pass


@dataclass
class Job:
    job_id: str
    process: str
    status: str = "accepted"
    message: str = ""
    result: object = None
    thread: threading.Thread | None = field(default=None, repr=False)


class Processes:
    """A registry of functions (spark, inputs) -> result; each job is one job group."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._all: dict[str, tuple[str, Callable]] = {}
        self._jobs: dict[str, Job] = {}

    def register(self, name: str, title: str, run: Callable) -> None:
        self._all[name] = (title, run)

    def list(self) -> dict[str, str]:
        return {k: v[0] for k, v in sorted(self._all.items())}

    def execute(self, name: str, inputs: dict | None = None, background: bool = False) -> Job:
        if name not in self._all:
            raise NoSuchProcess(name)
        job = Job(uuid.uuid4().hex, name)
        self._jobs[job.job_id] = job
        run = self._all[name][1]

        def work() -> None:
            self.spark.sparkContext.setJobGroup(job.job_id, name, interruptOnCancel=True)
            job.status = "running"
            try:
                job.result = run(self.spark, inputs or {})
                job.status = "successful" if job.status == "running" else job.status
            except Exception as e:
                job.message = str(e)
                job.status = "failed" if job.status == "running" else job.status

        if background:
            job.thread = threading.Thread(target=work, daemon=True)
            job.thread.start()
        else:
            work()
        return job

    def job(self, job_id: str) -> Job:
        if job_id not in self._jobs:
            raise NoSuchJob(job_id)
        return self._jobs[job_id]

    def jobs(self) -> list[Job]:
        return list(self._jobs.values())

    def result(self, job_id: str, timeout: float | None = None):
        """The result; a running job is waited for."""
        job = self.job(job_id)
        if job.thread:
            job.thread.join(timeout)
        if job.status == "failed":
            raise RuntimeError(job.message)
        return job.result

    def dismiss(self, job_id: str) -> None:
        job = self.job(job_id)
        job.status = "dismissed"
        self.spark.sparkContext.cancelJobGroup(job_id)
