"""Calls of an extraction service over HTTP, from tasks.

A failure is told from its status before its body is looked at, and no body of a failed call is kept.  What may pass (no answer, 408, 425, 429, 5xx) is a
``ConnectionError`` and tried again by whoever calls, within one deadline a unit; what spoils one document is a ``ValueError``; what would spoil
all others too (401, 402, 403, 407) is ``Fatal`` and ends the run.
"""

from __future__ import annotations

import json
import os
import re
import threading
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions.text import FATAL_STATUS, RETRIED_STATUS
from ..operators.requests import Fatal, run_job

#: Seconds of one unit in all, its retries and polls included.
DEADLINE_S = 300.0
#: Headers in which services name their version and the request, the first there counts.
VERSION_HEADERS = ("velrim-version", "x-velrim-api-version", "x-api-version", "api-version", "openai-version")
REQUEST_HEADERS = ("x-request-id", "request-id")
#: Characters of such a header that are kept.
HEADER_CHARS = 200


def status_failure(status: int) -> type[Exception] | None:
    """The error that a status stands for; null for an answer."""
    if status in RETRIED_STATUS or status >= 500:
        return ConnectionError
    if status in FATAL_STATUS:
        return Fatal
    return None if 200 <= status < 300 else ValueError


def plain_url(url: str) -> str:
    """A URL as it may be told: without query and user, a project's id blotted out."""
    return re.sub(r"/projects/[^/]+/", "/projects/<gcp-project>/", re.sub(r"//[^/@]*@", "//", url.partition("?")[0]), count=1)


@dataclass(frozen=True)
class Service:
    """Where a service is and how it knows its callers: the key is read from the environment of the machine that calls."""

    url: str
    key_env: str
    auth: str = "bearer"
    deadline: float = DEADLINE_S
    headers: dict[str, str] = field(default_factory=dict)

    def key(self) -> str:
        found = os.environ.get(self.key_env, "").strip()
        if not found:
            raise Fatal(f"{self.key_env} is not set")
        return found


class Client:
    """Calls of one unit: they share its deadline, and ``abort`` ends a wait at once."""

    def __init__(self, service: Service, now: Callable[[], float] = time.monotonic):
        self.service, self.now = service, now
        self.end = now() + service.deadline
        self.aborted = threading.Event()
        self.provenance: dict[str, str] = {}

    def abort(self) -> None:
        self.aborted.set()

    def left(self) -> float:
        if self.aborted.is_set():
            raise ConnectionError("aborted")
        seconds = self.end - self.now()
        if seconds <= 0:
            raise ConnectionError("deadline")
        return seconds

    def wait(self, seconds: float) -> None:
        """Up to so many seconds, as far as the deadline goes; ends with an error when aborted."""
        self.aborted.wait(min(seconds, self.left()))
        self.left()

    def send(self, path: str = "", body: object = None, method: str | None = None, form: bytes | None = None) -> object:
        """The answer to one call as JSON; ``body`` is JSON or its text, ``form`` the bytes of a file to upload."""
        own = self.service
        headers = {"x-goog-api-key": own.key()} if own.auth == "x-goog-api-key" else {"Authorization": f"Bearer {own.key()}"}
        data = None
        if form is not None:
            mark = uuid.uuid4().hex
            head = f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="document.pdf"\r\nContent-Type: application/pdf\r\n\r\n'
            data = head.encode() + form + f"\r\n--{mark}--\r\n".encode()
            headers["Content-Type"] = f"multipart/form-data; boundary={mark}"
        elif body is not None:
            data = (body if isinstance(body, str) else json.dumps(body)).encode()
            headers["Content-Type"] = "application/json"
        url = own.url.rstrip("/") + path
        request = urllib.request.Request(url, data, headers | own.headers, method=method or ("POST" if data is not None else "GET"))
        seconds = self.left()
        try:
            with urllib.request.build_opener(_NoRedirect).open(request, timeout=seconds) as answer:
                self._note(answer.headers)
                text = answer.read()
        except urllib.error.HTTPError as e:
            self._note(e.headers)
            e.close()
            raise (status_failure(e.code) or ValueError)(f"{e.code} from {plain_url(url)}") from None
        except (OSError, urllib.error.URLError) as e:
            raise ConnectionError(f"no answer from {plain_url(url)}: {type(e).__name__}") from None
        try:
            return json.loads(text)
        except ValueError:
            raise ValueError(f"no JSON from {plain_url(url)}") from None

    def _note(self, headers) -> None:
        first = lambda names: next((headers[n][:HEADER_CHARS] for n in names if headers.get(n)), None)
        said = {"apiVersion": first(VERSION_HEADERS), "requestId": first(REQUEST_HEADERS)}
        self.provenance = {k: v for k, v in said.items() if v is not None}


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    """A redirect would carry the key elsewhere: it is a failure of the document."""

    def redirect_request(self, *_):
        return None


def answers(service: Service) -> Callable[[dict], dict]:
    """For ``run_extraction``: a unit's ``body`` is sent, the answer comes back as it is."""

    def extract(unit: dict) -> dict:
        found = Client(service).send(body=unit["body"])
        if not isinstance(found, dict):
            raise ValueError("the answer is no object")
        return found

    return extract


def jobs(service: Service, every: float = 2.0, headroom: float = 0.0) -> Callable[[dict], dict]:
    """The same for services that take a file, start a job (a unit's ``body`` with the file's id in place of ``@file``) and are polled."""

    def extract(unit: dict) -> dict:
        client = Client(service)
        upload = lambda: client.send("/files", form=bytes(unit["content"]))
        create = lambda file: client.send("/jobs", body=unit["body"].replace("@file", file))
        end = time.monotonic() + client.left()
        return {"extract_result": run_job(upload, create, lambda job: client.send(f"/jobs/{job}"), end, every=every, headroom=headroom, sleep=client.wait)}

    return extract
