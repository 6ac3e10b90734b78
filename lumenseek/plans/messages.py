"""Texts for people: progress, status, reports, log lines."""

from __future__ import annotations

import json
import logging
import math
from datetime import datetime, timezone

from lumenseek.plans.indexing import IndexReport
from lumenseek.sources.chunk_store import IndexStats


def progress_text(current: int, total: int) -> str:
    return f"Indexing... {math.floor(current / total * 100 + 0.5)}%"


def ready_text(chunks: int | None = None) -> str:
    return "Ready" if chunks is None else f"Ready | {chunks:,} chunks"


def stats_text(stats: IndexStats) -> str:
    megabytes = stats.storage_size / (1024 * 1024)
    return (f"Files indexed: {stats.file_count}\nTotal chunks: {stats.chunk_count}\n"
            f"Storage size: {megabytes:.2f} MB")


def report_text(report: IndexReport) -> str:
    if not report.success:
        return "Indexing failed: " + "; ".join(report.errors)
    lines = [f"Files: {report.total_files}",
             f"Chunks: {report.successful_chunks}/{report.total_chunks} ({report.success_rate:.1f}%)",
             f"Duration: {report.duration_ms / 1000:.1f}s"]
    if report.failed_chunks:
        lines.append(f"{report.failed_chunks} chunks failed to embed")
    return "\n".join(lines)


class LineFormatter(logging.Formatter):
    """``[time] [LEVEL] [component] message`` plus extra arguments as JSON.

    Extra arguments are passed as ``extra={"details": [...]}``.
    """

    def format(self, record: logging.LogRecord) -> str:
        when = datetime.fromtimestamp(record.created, timezone.utc).isoformat(timespec="milliseconds")
        level = "WARN" if record.levelname == "WARNING" else record.levelname
        details = getattr(record, "details", None)
        tail = f" {json.dumps(details, default=str)}" if details else ""
        return f"[{when.replace('+00:00', 'Z')}] [{level}] [{record.name}] {record.getMessage()}{tail}"
