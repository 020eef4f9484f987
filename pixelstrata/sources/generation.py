"""Pictures from a remote service that runs node graphs: jobs are sent, followed until they end, and their pictures fetched.

The service answers POST /prompt with a prompt_id, GET /history/<id> with the ended job's outputs, GET /view with a file. Jobs
run where their rows are, one after another in a task; the number of partitions is the number of jobs the service gets at
once. A job that is refused, fails or falls silent is one row's error.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame


class JobError(Exception):
    """What a job's row says in error."""


@dataclass(frozen=True)
class Service:
    """Where the service is, and how it is asked: seconds between looks, misses in a row and seconds of silence that end a job."""

    url: str
    pause: float = 1.0
    misses: int = 3
    silence: float = 180.0
    timeout: float = 30.0

    def ask(self, path: str, body: dict | None = None) -> bytes:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.url.rstrip("/") + path, data, {"Content-Type": "application/json"} if data else {})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return reply.read()

    def send(self, graph: dict) -> str:
        try:
            reply = json.loads(self.ask("/prompt", {"prompt": graph}))
        except urllib.error.HTTPError as e:
            raise JobError(f"refused: {e.read().decode(errors='replace')[:200]}") from None
        except (OSError, ValueError) as e:
            raise JobError(f"not sent: {e}") from None
        if not isinstance(reply, dict) or "prompt_id" not in reply:
            raise JobError(f"refused: {json.dumps(reply)[:200]}")
        return str(reply["prompt_id"])

    def outputs(self, job: str) -> dict:
        """The outputs of a job, once it has any."""
        missed, heard = 0, time.monotonic()
        while True:
            time.sleep(self.pause)
            try:
                held = json.loads(self.ask(f"/history/{job}"))
            except (OSError, ValueError):
                missed += 1
                if missed >= self.misses:
                    raise JobError("the service stopped answering") from None
                continue
            missed = 0
            entry = held.get(job) if isinstance(held, dict) else None
            if entry is None:
                if time.monotonic() - heard >= self.silence:
                    raise JobError(f"nothing heard for {self.silence:g} seconds")
                continue
            if (entry.get("status") or {}).get("status_str") == "error":
                raise JobError(_trouble(entry["status"]))
            if entry.get("outputs"):
                return entry["outputs"]

    def pictures(self, outputs: dict) -> list[tuple[str, bytes]]:
        """The files of the outputs' kept pictures; those that do not come down are left out, but not all of them may be."""
        wanted = [x for node in outputs.values() for x in node.get("images", []) if x.get("type", "output") == "output"]
        if not wanted:
            raise JobError("the job made no pictures")
        found = []
        for x in wanted:
            query = urllib.parse.urlencode({"filename": x.get("filename", ""), "subfolder": x.get("subfolder", ""), "type": x.get("type", "output")})
            try:
                found.append((x.get("filename", ""), self.ask(f"/view?{query}")))
            except OSError:
                continue
        if not found:
            raise JobError("no picture came down")
        return found


def _trouble(status: dict) -> str:
    for kind, detail in (m for m in status.get("messages", []) if isinstance(m, list) and len(m) > 1):
        if kind == "execution_error":
            return f"{detail.get('node_type', 'a node')} failed: {str(detail.get('exception_message', '')).splitlines()[:1]}"
    return "the job failed"


def generated(jobs: DataFrame, service: Service) -> DataFrame:
    """(job, number, name, content, error) for jobs (job, graph: JSON of {"prompt": nodes}): a row for each picture, or one that says
    why there is none. Reading it runs the jobs; write the result before it is read twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job, graph in zip(batch.column("job").to_pylist(), batch.column("graph").to_pylist(), strict=True):
                try:
                    nodes = json.loads(graph or "null")
                    if not isinstance(nodes, dict) or "prompt" not in nodes:
                        raise JobError("no graph")
                    found = service.pictures(service.outputs(service.send(nodes["prompt"])))
                    rows = [(job, i, name, content, None) for i, (name, content) in enumerate(found)]
                except (JobError, ValueError) as e:
                    rows = [(job, None, None, None, str(e))]
                columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.string()), strict=True)
                yield pa.record_batch([pa.array(list(c), t) for c, t in columns], names=["job", "number", "name", "content", "error"])

    return jobs.select("job", "graph").mapInArrow(run, "job long, number int, name string, content binary, error string")
