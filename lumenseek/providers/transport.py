"""JSON over HTTP with the standard library, and what its failures mean."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from dataclasses import dataclass

from lumenseek import fixed_values as fv


class ServiceError(Exception):
    """A model service failed; ``str(error)`` is the text shown to the user."""


@dataclass
class HttpFailure(Exception):
    status: int | None = None
    reason: str = ""
    body: dict | None = None
    code: str = ""


class JsonTransport:
    """Minimal JSON client. Pass another object with ``call`` to replace it."""

    def __init__(self, base_url: str, headers: dict[str, str] | None = None, timeout: float = 30.0):
        self.base_url = base_url.rstrip("/")
        self.headers = {"Content-Type": "application/json", **(headers or {})}
        self.timeout = timeout

    def call(self, path: str, body: dict | None = None, timeout: float | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.base_url + path, data=data, headers=self.headers)
        try:
            with urllib.request.urlopen(request, timeout=timeout or self.timeout) as reply:
                return json.loads(reply.read() or b"{}")
        except urllib.error.HTTPError as error:
            try:
                body = json.loads(error.read())
            except ValueError:
                body = None
            raise HttpFailure(error.code, error.reason, body) from error
        except TimeoutError as error:
            raise HttpFailure(code="ETIMEDOUT", reason=str(error)) from error
        except urllib.error.URLError as error:
            refused = isinstance(error.reason, ConnectionRefusedError)
            timed = isinstance(error.reason, TimeoutError)
            code = "ECONNREFUSED" if refused else "ETIMEDOUT" if timed else ""
            raise HttpFailure(code=code, reason=str(error.reason)) from error


def local_error(failure: Exception) -> ServiceError:
    """User text for a failure of the local model server."""
    if not isinstance(failure, HttpFailure):
        return ServiceError(str(failure))
    if failure.code in fv.LOCAL_SERVICE_TEXTS:
        return ServiceError(fv.LOCAL_SERVICE_TEXTS[failure.code])
    if failure.status is not None:
        return ServiceError(fv.LOCAL_SERVICE_ERROR.format(f"{failure.status} {failure.reason}"))
    return ServiceError(failure.reason)


def hosted_error(failure: Exception) -> ServiceError:
    """User text for a failure of the hosted service."""
    if not isinstance(failure, HttpFailure):
        return ServiceError(str(failure))
    if failure.status in fv.HOSTED_SERVICE_TEXTS:
        return ServiceError(fv.HOSTED_SERVICE_TEXTS[failure.status])
    if failure.status is not None:
        message = ((failure.body or {}).get("error") or {}).get("message")
        return ServiceError(fv.HOSTED_SERVICE_ERROR.format(message or f"{failure.status} {failure.reason}"))
    if failure.code in fv.HOSTED_SERVICE_TEXTS:
        return ServiceError(fv.HOSTED_SERVICE_TEXTS[failure.code])
    return ServiceError(failure.reason)


class RequestBudget:
    """Requests per minute with proportional refill.

    Each Spark task holds its own budget, so a cluster-wide limit is divided
    by the number of concurrent embedding tasks before it gets here.
    """

    def __init__(self, per_minute: float, clock=time.monotonic, sleep=time.sleep):
        self.per_minute = per_minute
        self._clock, self._sleep = clock, sleep
        self.reset()

    def reset(self) -> None:
        self.tokens, self.refilled = float(self.per_minute), self._clock()

    def _refilled(self) -> float:
        return min(self.per_minute, self.tokens + (self._clock() - self.refilled) / 60 * self.per_minute)

    def can_request(self) -> bool:
        return self._refilled() >= 1

    def acquire(self) -> None:
        waited = self._clock() - self.refilled
        self.tokens, self.refilled = self._refilled(), self._clock()
        if self.tokens < 1:
            self._sleep(max(0.0, 60 - waited))
            self.reset()
        self.tokens -= 1
