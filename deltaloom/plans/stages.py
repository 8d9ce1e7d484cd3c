"""Runs in stages that resume: a stage is skipped only if all its outputs are still what they were."""

from __future__ import annotations

import contextlib
import fcntl
import functools
import hashlib
import inspect
import json
import os
import platform
import resource
import shutil
import socket
import subprocess
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.sources.sinks import digest, write_json
from deltaloom.sources.store import Place


def fingerprints(paths: list[Path | Place]) -> dict[str, str]:
    return {str(p): digest(p) for p in paths}


def stage(state: dict, state_path: Path | Place, name: str, outputs: list[Path | Place], action: Callable[[], None]) -> bool:
    """Run action unless state says it is done and its outputs are unchanged; True if it ran."""
    if name in state:
        if any(not p.exists() for p in outputs) or fingerprints(outputs) != state[name]:
            raise RuntimeError(f"outputs of {name} have changed since it ran")
        return False
    action()
    if missing := [str(p) for p in outputs if not p.exists()]:
        raise RuntimeError(f"{name} did not write {missing}")
    state[name] = fingerprints(outputs)
    write_json(state, state_path)
    return True


def identity(config: dict, commit: str) -> str:
    return hashlib.sha256((commit + json.dumps(config, sort_keys=True)).encode()).hexdigest()


def git_commit(root: Path, clean: bool = True) -> str:
    """The commit of a work tree, which must have no changes if clean."""
    git = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True, text=True).stdout.strip()
    if clean and git("status", "--porcelain"):
        raise RuntimeError("the work tree has changes that aren't committed")
    return git("rev-parse", "HEAD")


def load_state(path: Path | Place, run_id: str) -> dict:
    """The state of this very run; that of another is an error."""
    state = json.loads(path.read_text()) if path.exists() else {}
    if state.setdefault("run", run_id) != run_id:
        raise RuntimeError("the folder holds another run")
    return state


@contextlib.contextmanager
def locked(path: Path | Place) -> Iterator[None]:
    """Held by one run at a time. On a local path the lock ends with its process; elsewhere a file says who holds it."""
    if isinstance(path, Place):
        _claim(path)
        try:
            yield
        finally:
            path.unlink()
        return
    with path.open("w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise RuntimeError("another run holds the lock") from e
        yield


def _claim(path: Place) -> None:
    """Create the lock, which the file system grants once. That of a process of this machine that is no more is taken over; any other must be released."""
    mine = json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "since": time.time()})
    for _ in range(2):
        try:
            return path.create_text(mine)
        except FileExistsError:
            owner = json.loads(path.read_text() or "{}")
            if owner.get("host") != socket.gethostname() or _alive(owner.get("pid", 0)):
                raise RuntimeError(f"another run holds the lock {path}: {owner}") from None
            path.unlink()
    raise RuntimeError(f"another run has taken the lock {path}")


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        pass
    return True


def release(path: Place) -> None:
    """Take away the lock of a run that is known to have ended."""
    if path.exists():
        path.unlink()


def claimed(run: Callable) -> Callable:
    """A study (with parameters spark and out) that holds the lock beside its folder while it runs."""
    signature = inspect.signature(run)

    @functools.wraps(run)
    def held(*args: object, **kwargs: object) -> object:
        given = signature.bind(*args, **kwargs).arguments
        with locked(Place(given["spark"], f"{str(given['out']).rstrip('/')}.lock")):
            return run(*args, **kwargs)

    return held


def memory_limit() -> int:
    """Bytes this process may use: of the machine or its control group."""
    known = [os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")]
    for p in ("/sys/fs/cgroup/memory.max", "/sys/fs/cgroup/memory/memory.limit_in_bytes"):
        with contextlib.suppress(OSError, ValueError):
            known.append(int(Path(p).read_text()))
    return min(known)


def require_resources(folder: Path, memory: int, scratch: int) -> dict[str, int]:
    found = {"memory": memory_limit(), "scratch": shutil.disk_usage(folder).free}
    if found["memory"] < memory or found["scratch"] < scratch:
        raise RuntimeError(f"needs {memory} bytes of memory and {scratch} of scratch; there are {found}")
    return found


def frozen_selection(path: Path | Place, key: dict, select: Callable[[], dict]) -> dict:
    """A selection made once and written before held-out labels are read.

    A selection found there is used only if it was made from the same config,
    sources and axes.
    """
    if path.exists():
        known = json.loads(path.read_text())
        if known["key"] != key:
            raise RuntimeError("the frozen selection is of other inputs")
        return known["selection"]
    chosen = select()
    write_json({"key": key, "selection": chosen}, path)
    return chosen


def require_new(*paths: Path | Place) -> None:
    if there := [str(p) for p in paths if p.exists()]:
        raise FileExistsError(f"already there: {there}")


def require_manifest(found: dict, expected: dict, keys: list[str]) -> None:
    if wrong := [k for k in keys if found.get(k) != expected.get(k)]:
        raise ValueError(f"manifest differs in {wrong}")


def require_version(found: str, pinned: str) -> None:
    if found != pinned:
        raise RuntimeError(f"version {found}, pinned {pinned}")


def manifest_paths(manifest: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """(path, sha256) rows under a prefix with a suffix."""
    return manifest.where(F.col("path").startswith(prefix) & F.col("path").endswith(suffix))


def verified_inputs(manifest: dict[str, str], paths: list[Path]) -> dict[str, str]:
    """Digests of inputs, each of which the manifest must have as it is."""
    found = fingerprints(paths)
    if wrong := [p for p, d in found.items() if manifest.get(p) != d]:
        raise ValueError(f"not as in the manifest: {wrong}")
    return found


def provenance(began: float, inputs: dict[str, str], commit: str | None = None) -> dict:
    """What a report says of how it came about."""
    import pyspark

    return {
        "commit": commit, "inputs": inputs, "elapsed_seconds": time.time() - began, "peak_rss_bytes": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024,
        "versions": {"python": platform.python_version(), "pyspark": pyspark.__version__}, "made": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()),
    }
