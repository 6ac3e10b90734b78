"""Health of the local model server."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass

#: The health check of the local server asks for this model whatever model is configured.
CHECKED_MODEL = "nomic-embed-text"


@dataclass(frozen=True)
class HealthStatus:
    running: bool
    model_installed: bool
    message: str


def check_health(provider) -> HealthStatus:
    try:
        if not provider.check_connection():
            return HealthStatus(False, False, "Ollama is not running")
        if not provider.is_model_available(CHECKED_MODEL if provider.name == "ollama" else None):
            return HealthStatus(True, False, "Model not installed")
        return HealthStatus(True, True, "Ollama ready")
    except Exception as error:
        return HealthStatus(False, False, str(error))


class HealthPoller:
    """Calls back with the status now and every ``interval`` seconds; 0 means never again."""

    def __init__(self, provider, interval: float, on_status: Callable[[HealthStatus], None]):
        self.provider, self.interval, self.on_status = provider, interval, on_status
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None

    def start(self) -> None:
        self.stop()
        self._stop = threading.Event()
        self.on_status(check_health(self.provider))
        if self.interval > 0:
            self._thread = threading.Thread(target=self._loop, args=(self._stop,), daemon=True)
            self._thread.start()

    def _loop(self, stop: threading.Event) -> None:
        while not stop.wait(self.interval):
            self.on_status(check_health(self.provider))

    def stop(self) -> None:
        self._stop.set()
