"""Child programs: one run per file with bounded output, and a lasting child that answers a line of
JSON with a line of JSON."""

from __future__ import annotations

import json
import os
import queue
import subprocess
import threading
import time
from collections.abc import Mapping, Sequence

#: Why a child failed: it could not be run at all, or it died or fell silent at work.
INFRASTRUCTURE, CHILD = "INFRASTRUCTURE_FAILURE", "LEAN_FAILURE"
TIMED_OUT, NOT_RUN = -1000, -1001


class ChildFailure(Exception):
    """The child is gone; what it was asked has no verdict."""

    def __init__(self, message: str, failure_class: str):
        super().__init__(message)
        self.failure_class = failure_class


def environment(extra: Mapping[str, str] | None = None) -> dict[str, str]:
    """The executor's environment with some variables set."""
    return {**os.environ, **(extra or {})}


def run_once(command: Sequence[str], seconds: float, most_bytes: int, extra: Mapping[str, str] | None = None) -> tuple[int, str]:
    """Exit code (TIMED_OUT, NOT_RUN) and the first most_bytes of both outputs together. A child
    that says more is still read to its end, so that it does not hang, but not kept."""
    try:
        child = subprocess.Popen(list(command), stdout=subprocess.PIPE, stderr=subprocess.STDOUT, stdin=subprocess.DEVNULL, env=environment(extra))
    except OSError as e:
        return NOT_RUN, str(e)
    late = threading.Timer(seconds, child.kill)
    late.start()
    kept, size = [], 0
    for part in iter(lambda: child.stdout.read1(65536), b""):
        kept.append(part[: max(0, most_bytes - size)])
        size += len(part)
    code = child.wait()
    timely = late.is_alive()
    late.cancel()
    return (code if timely else TIMED_OUT), b"".join(kept).decode("utf-8", "replace")


class LineClient:
    """A lasting child. ``ask`` sends an object and waits for the answer; a child that dies or is
    late is killed and raises ChildFailure, and the next ask starts a new one."""

    def __init__(self, command: Sequence[str], startup: float = 120.0, seconds: float = 30.0, extra: Mapping[str, str] | None = None):
        self.command, self.startup, self.seconds, self.extra = list(command), startup, seconds, extra
        self.child: subprocess.Popen | None = None
        self.starts = 0

    def start(self) -> dict:
        """Starts a child unless one runs; its first line says that it is ready."""
        if self.child is not None and self.child.poll() is None:
            return {}
        try:
            self.child = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=environment(self.extra), text=True, encoding="utf-8")
        except OSError as e:
            raise ChildFailure(f"cannot run {self.command[0]}: {e}", INFRASTRUCTURE) from e
        self.starts += 1
        self.lines: queue.Queue = queue.Queue()
        threading.Thread(target=self._read, args=(self.child.stdout, self.lines), daemon=True).start()
        ready = self._line(self.startup, "did not get ready", INFRASTRUCTURE)
        if ready.get("error"):
            self.close()
            raise ChildFailure(f"did not start: {ready['error']}", CHILD)
        return ready

    @staticmethod
    def _read(pipe, lines: queue.Queue) -> None:
        for line in pipe:
            lines.put(line)
        lines.put(None)

    def _line(self, seconds: float, what: str, failure: str) -> dict:
        try:
            line = self.lines.get(timeout=seconds)
            if line is not None:
                return json.loads(line)
        except (queue.Empty, json.JSONDecodeError):
            pass
        self.close()
        raise ChildFailure(f"the child {what} (gone or no answer in {seconds} s)", failure)

    def ask(self, request: dict) -> dict:
        self.start()
        try:
            self.child.stdin.write(json.dumps(request) + "\n")
            self.child.stdin.flush()
        except OSError as e:
            self.close()
            raise ChildFailure(f"the child is gone: {e}", CHILD) from e
        return self._line(self.seconds, "did not answer", CHILD)

    def close(self) -> None:
        """Ends the child; again is harmless."""
        child, self.child = self.child, None
        if child is not None:
            child.kill()
            child.wait()
            child.stdin.close()

    def __enter__(self) -> LineClient:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class Session:
    """Actions on a lasting child with its state: fresh, ready, success, error or crashed."""

    def __init__(self, client: LineClient, imports: Sequence[str] = ()):
        self.client, self.imports, self.state, self.errors, self.infos = client, tuple(imports), "fresh", [], []

    def load(self, imports: Sequence[str]) -> None:
        """The imports are fixed when a child starts: other ones need a new child."""
        if tuple(imports) != self.imports:
            self.imports = tuple(imports)
            self.reset()

    def reset(self) -> None:
        self.client.close()
        self.state, self.errors, self.infos = "fresh", [], []

    def submit(self, source: str | None, keep: bool = True) -> dict:
        """Sends a source without its import lines; a record of the action. A child that fails is
        no verdict on the source: RESOURCE_LIMIT, with the failure's class."""
        before, t = self.state, time.perf_counter()
        text = "\n".join(x for x in (source or "").splitlines() if not x.lstrip().startswith("import "))
        try:
            if self.client.start():
                self.state = "ready"
                if self.imports:
                    self.client.ask({"op": "imports", "modules": list(self.imports)})
            said = self.client.ask({"op": "verify", "source": text, "update_env": keep})
            told = said.get("messages") or []
            self.errors = [m.get("data", "") for m in told if m.get("severity") == "error"] or ([said["error"]] if said.get("error") else [])
            self.infos = [m.get("data", "") for m in told if m.get("severity") == "information"]
            if said.get("error"):
                self.state, status, failure = "infrastructure_error", "RESOURCE_LIMIT", CHILD
            elif said.get("status") == "success":
                self.state, status, failure = "success", "SUCCESS", None
            else:
                self.state, status, failure = "error", "FAIL_TYPECHECK", "MODEL_FAILURE"
        except ChildFailure as e:
            self.state, self.errors, status, failure = "crashed", [str(e)], "RESOURCE_LIMIT", e.failure_class
        return {"previous_state": before, "next_state": self.state, "status": status, "failure_class": failure, "messages": list(self.errors), "infos": list(self.infos), "seconds": time.perf_counter() - t}
