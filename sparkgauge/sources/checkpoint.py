"""The append-only run log: durable writes, torn tails, resume."""

from __future__ import annotations

import json
import os
import socket
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jsonl import InputError

VERSION = 3


@dataclass
class Log:
    header: dict
    records: list[dict]
    events: list[dict]
    torn: bool


def durable_write(path: str | Path, text: str) -> None:
    """Replace a file as a whole: temporary file, flush to disk, rename."""
    path = Path(path)
    own = path.with_name(f".{path.name}.{os.getpid()}")
    with own.open("w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    own.replace(path)


def durable_append(path: str | Path, row: dict, lease: Lease | None = None) -> None:
    """Append a row and flush it to disk; with a lease only if it still holds."""
    if lease is not None:
        lease.check()
    with Path(path).open("a") as f:
        f.write(json.dumps(row, separators=(",", ":")) + "\n")
        f.flush()
        os.fsync(f.fileno())


def damage(spark: SparkSession, path: str) -> tuple[int | None, int | None]:
    """Line numbers (from 1) of the first line that isn't JSON and of the last that is."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line")).filter("line <> ''")
    good = F.try_parse_json("line").isNotNull()
    r = rows.agg(F.min(F.when(~good, F.col("n") + 1)), F.max(F.when(good, F.col("n") + 1))).first()
    return r[0], r[1]


def load(path: str | Path, fingerprint: str) -> Log | None:
    """The log if it belongs to this run; a torn last line is left out, damage inside is refused."""
    path = Path(path)
    if not path.exists():
        return None
    rows, torn = [], False
    lines = [x for x in path.read_text().split("\n") if x]
    for i, line in enumerate(lines):
        try:
            rows.append(json.loads(line))
        except ValueError:
            if i != len(lines) - 1:
                raise InputError(f"checkpoint {path}:{i + 1}: damaged") from None
            torn = True
    if not rows or rows[0].get("kind") != "header" or rows[0].get("version") != VERSION or rows[0].get("fingerprint") != fingerprint:
        return None
    seen: dict[tuple, dict] = {}
    for r in rows[1:]:
        if r.get("kind") == "prediction":
            seen.setdefault((r["docClass"], r["doc"], r["repeat"]), r)
    return Log(rows[0], list(seen.values()), [r for r in rows[1:] if r.get("kind") in ("circuit_open", "manual_resume")], torn)


def start(path: str | Path, fingerprint: str, started_at: str, code_state: str) -> None:
    """A fresh log; one of another run is set aside."""
    path = Path(path)
    if path.exists():
        n = 1
        while (aside := path.with_name(f"{path.name}.stale-{n}")).exists():
            n += 1
        path.rename(aside)
    durable_write(path, json.dumps({"kind": "header", "version": VERSION, "fingerprint": fingerprint, "startedAt": started_at, "codeState": code_state}) + "\n")


def pending(planned: DataFrame, repeats: int, done: DataFrame) -> DataFrame:
    """Planned documents times repeats, less what the log has."""
    units = planned.select("doc_class", "doc", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    return units.join(done.select("doc_class", "doc", "repeat").distinct(), ["doc_class", "doc", "repeat"], "left_anti")


class LeaseError(RuntimeError):
    """The folder is another run's."""


def _started(pid: int) -> str | None:
    """When a process of this machine began, so that a number that was used again isn't taken for it; null where that can't be told."""
    try:
        return Path(f"/proc/{pid}/stat").read_text().rpartition(")")[2].split()[19]
    except (OSError, IndexError):
        return None


def _alive(owner: dict) -> bool:
    try:
        os.kill(owner["pid"], 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        pass  # another user's: it is there
    now, then = _started(owner["pid"]), owner.get("started")
    return now is None or then is None or now == then


class Lease:
    """An output folder's owner: one run at a time.

    The record names the owner by a nonce, its machine, its process and what it runs.  That of a dead process of this machine may be
    recovered, if asked for; one of another machine, or that can't be read, may not.  Who recovers holds a second record
    meanwhile, looks again whether the owner is the one found dead, and moves its record aside rather than over.  ``check`` fails for an
    owner that was recovered from, so it appends nothing any more.
    """

    def __init__(self, folder: str | Path, fingerprint: str = "", recover: bool = True):
        self.path = Path(folder) / ".lease"
        self.guard = Path(folder) / ".lease.recovery"
        self.recover = recover
        pid = os.getpid()
        self.owner = {"version": 1, "nonce": uuid.uuid4().hex, "pid": pid, "started": _started(pid), "host": socket.gethostname(), "acquiredAt": datetime.now(UTC).isoformat(), "fingerprint": fingerprint}

    @staticmethod
    def _put(path: Path, owner: dict) -> None:
        """Create a record that isn't there; its text is whole as soon as it has its name."""
        own = path.with_name(f"{path.name}.{owner['nonce']}")
        with own.open("x") as f:
            f.write(json.dumps(owner))
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(own, path)
        finally:
            own.unlink()

    @staticmethod
    def _read(path: Path) -> dict | None:
        try:
            said = json.loads(path.read_text())
        except FileNotFoundError:
            return None
        except ValueError:
            raise LeaseError(f"{path} can't be read") from None
        if isinstance(said, int):  # a bare process number, as earlier versions left it
            return {"pid": said, "nonce": f"plain-{said}", "host": socket.gethostname()}
        if not isinstance(said, dict) or not isinstance(said.get("pid"), int) or not said.get("nonce"):
            raise LeaseError(f"{path} can't be read")
        return said

    def _dead(self) -> dict | None:
        """The record of an owner that is gone; null if there is none any more; an error if it may still run."""
        owner = self._read(self.path)
        if owner is None:
            return None
        if owner.get("host") != self.owner["host"]:
            raise LeaseError(f"{self.path} is held on {owner.get('host')}")
        if _alive(owner):
            raise LeaseError(f"{self.path} is held by process {owner['pid']}")
        return owner

    def _take_over(self, found: dict) -> bool:
        mark = {**self.owner, "nonce": uuid.uuid4().hex}
        try:
            self._put(self.guard, mark)
        except FileExistsError:
            raise LeaseError(f"{self.path} is being recovered") from None
        try:
            again = self._dead()
            if again is None or again["nonce"] != found["nonce"]:
                return False
            os.rename(self.path, self.path.with_name(f"{self.path.name}.stale-{found['nonce']}"))
            try:
                self._put(self.path, self.owner)
            except FileExistsError:
                return False  # someone came between
            return True
        finally:
            held = self._read(self.guard)
            if held and held["nonce"] == mark["nonce"]:
                self.guard.unlink()

    def acquire(self) -> Lease:
        while True:
            if self.guard.exists():
                raise LeaseError(f"{self.path} is being recovered")
            try:
                self._put(self.path, self.owner)
            except FileExistsError:
                found = self._dead()
                if found is None:
                    continue
                if not self.recover:
                    raise LeaseError(f"{self.path} is of process {found['pid']}, which is gone; it may be recovered") from None
                if self._take_over(found):
                    return self
                continue
            if self.guard.exists():
                # someone recovers what was there before: not against it
                self.release()
                raise LeaseError(f"{self.path} is being recovered")
            return self

    def check(self) -> None:
        """Fail unless this is still the owner."""
        now = self._read(self.path)
        if now is None or now["nonce"] != self.owner["nonce"]:
            raise LeaseError(f"{self.path} is another run's now")

    def release(self) -> None:
        now = self._read(self.path)
        if now and now["nonce"] == self.owner["nonce"]:
            self.path.unlink()

    def __enter__(self) -> Lease:
        return self.acquire()

    def __exit__(self, *_) -> None:
        self.release()
