"""Runs of other programs under supervision: a time limit, a log that is exported as it grows, tries, and verified backups."""

from __future__ import annotations

import subprocess
import time
from collections.abc import Callable, Iterable
from pathlib import Path

from deltaloom.sources.sinks import digest, write_json

#: Seconds a command may take, between two exports of its log, and for it to end when told to.
LIMIT, EXPORT, GRACE = 5400.0, 15.0, 30.0


def supervise(command: list[str], log: Path, limit: float = LIMIT, tries: int = 1, export: Callable[[Path], object] | None = None, every: float = EXPORT) -> int:
    """Run command until it succeeds, tries times at most; how many it took.

    Every try appends to log, which export gets now and then and after each try.
    As stages skip what is done, another try resumes. Only the process that was
    started is ended at the limit, by force if it doesn't end when told to.
    """
    said = ""
    for n in range(1, tries + 1):
        with log.open("ab") as out:
            process = subprocess.Popen(command, stdout=out, stderr=subprocess.STDOUT, stdin=subprocess.DEVNULL)
            try:
                code = _wait(process, time.monotonic() + limit, every, lambda: export and export(log))
            finally:
                _end(process)
        if export:
            export(log)
        if code == 0:
            return n
        said = f"not done after {limit} s" if code is None else f"exit {code}"
    raise RuntimeError(f"{command[0]}: {said}; see {log}")


def _wait(process: subprocess.Popen, end: float, every: float, tick: Callable[[], object]) -> int | None:
    """The exit code, or None at the end of the time."""
    while (left := end - time.monotonic()) > 0:
        try:
            return process.wait(min(every, left))
        except subprocess.TimeoutExpired:
            tick()
    return process.poll()


def _end(process: subprocess.Popen) -> None:
    if process.poll() is not None:
        return
    process.terminate()
    try:
        process.wait(GRACE)
    except subprocess.TimeoutExpired:
        process.kill()
        process.wait()


def back_up(paths: Iterable[Path], receipt: Path, store: Callable[[Path], str], known: dict) -> list[Path]:
    """Store the files that known (the receipt's content) doesn't have as they are; those stored, in order.

    store returns the SHA-256 of what it reads back. The receipt is written after
    each file, so that a run that ends early loses nothing it has backed up.
    """
    done = []
    for path in paths:
        now = {"size": path.stat().st_size, "sha256": digest(path)}
        if known.get(str(path)) == now:
            continue
        if store(path) != now["sha256"]:
            raise OSError(f"the backup of {path} differs from it")
        known[str(path)] = now
        write_json(known, receipt)
        done.append(path)
    return done
