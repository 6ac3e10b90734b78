"""A stage that survives the rows it cannot process.

An exception inside a built-in expression ends the job and names no row. Here
the job is tried on everything first. When it fails, the rows are halved by the
hash of their key, again and again, until the failing keys are alone; those
become error rows and everything else is written. Without a failure nothing is
added to the one job. A failing key costs about two jobs per doubling of the
keys, each on half of the rows of the one before: every second time the rows of
a failing part are written, and its halves read those instead of everything.
Parts of one size are tried side by side.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from lumenseek.session import shared_folder

#: Failing keys after which a run is given up: then the cause is not the rows.
MOST_FAILURES = 1000
#: Parts that are tried at a time, and halvings after which the rows of a failing part are written.
AT_A_TIME, HALVINGS = 8, 2
#: Halvings that the bits of a hash allow.
MOST_HALVINGS = 62


class TooManyFailures(RuntimeError):
    pass


@dataclass(frozen=True)
class Part:
    """Rows of ``source`` with a key whose hash ends in the ``level`` bits ``rest``; all rows of the source share ``known`` of them."""

    source: DataFrame
    known: int = 0
    level: int = 0
    rest: int = 0

    def rows(self, key: str) -> DataFrame:
        if self.level == self.known:
            return self.source
        return self.source.where(F.pmod(F.xxhash64(key), F.lit(1 << self.level)) == self.rest)

    def halves(self) -> list[Part]:
        return [Part(self.source, self.known, self.level + 1, self.rest + add) for add in (0, 1 << self.level)]


def reason(error: Exception) -> str:
    """The innermost message of a failed job, without its traces."""
    text = str(error)
    found = re.findall(r"(?:^|[\s:])(?:[\w$]+\.)*\w*(?:Exception|Error): ([^\n]+)", text)
    message = found[-1] if found else text.strip().split("\n")[0]
    return re.sub(r"^\[[A-Z_.]+\] |\s*SQLSTATE: \w+\s*$", "", message).strip()


def isolated(rows: DataFrame, work: Callable[[DataFrame], DataFrame], key: str, *,
             most_failures: int = MOST_FAILURES) -> tuple[DataFrame, DataFrame]:
    """``work(rows)`` written to the shared folder without the keys it fails for, and ``key``, ``error`` of those.

    ``work`` must treat every key by itself. What fails without rows, or
    before any row is read, is raised.
    """
    spark = rows.sparkSession
    out = shared_folder(spark, "isolated")
    schema = work(rows).schema

    def tried(part: Part) -> tuple[list[str], list, list[tuple[str, list[Part]]]]:
        """The folder with the part's work, or its failing keys with the reason, or the reason and halves to try."""
        mine, name = part.rows(key), f"{part.level}-{part.rest}"
        try:
            work(mine).write.parquet(f"{out}/{name}")
            return [f"{out}/{name}"], [], []
        except AnalysisException:
            raise
        except Exception as error:
            keys = [r[0] for r in mine.select(key).distinct().limit(2).collect()]
            if not keys:
                raise
            if len(keys) == 1 or part.level >= MOST_HALVINGS:
                return [], [(k, reason(error)) for k in keys], []
            why = reason(error)
        if part.level - part.known >= HALVINGS:
            try:
                mine.write.parquet(f"{out}/rows-{name}")
                part = Part(spark.read.schema(mine.schema).parquet(f"{out}/rows-{name}"), part.level, part.level, part.rest)
            except Exception:
                pass  # reading a row fails: the halves read from where this part did
        return [], [], [(why, part.halves())]

    parts, failed, written = [Part(rows)], [], []
    with ThreadPoolExecutor(AT_A_TIME) as pool:
        while parts:
            failing = []
            for done, bad, more in pool.map(tried, parts):
                written += done
                failed += bad
                failing += more
            # Parts share no key, so every failing one has at least one of its own.
            if len(failed) + len(failing) > most_failures:
                last = failing[-1][0] if failing else failed[-1]
                raise TooManyFailures(f"more than {most_failures} failing rows, the last one: {last}")
            parts = [half for _, halves in failing for half in halves]
    key_type = dict(rows.dtypes)[key]
    errors = spark.createDataFrame(failed, f"`{key}` {key_type}, error string")
    done = spark.read.schema(schema).parquet(*written) if written else spark.createDataFrame([], schema)
    return done, errors
