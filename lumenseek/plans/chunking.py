"""Source files to chunk rows: one narrow stage, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumenseek import fixed_values as fv
from lumenseek.operators import cutting as cut
from lumenseek.operators.syntax import scan_syntax
from lumenseek.session import apply_steps, cached_steps


@cached_steps
def _cut_steps(compat: bool, max_lines: int, merge_small: bool, overlap: bool):
    pieces = F.col("pieces")
    steps = [
        ("grouped", cut.first_per_line(cut.group_imports(F.col("points")))),
        ("breaks", cut.lift_over_comments(F.col("grouped"), F.col("comments"))),
        ("pieces", cut.cut(F.col("lines"), F.col("breaks"))),
        ("pieces", cut.split_large(pieces, max_lines)),
    ]
    if merge_small:
        steps.append(("pieces", cut.merge_small(pieces)))
    if overlap:
        steps.append(("pieces", cut.add_overlap(pieces)))
    if compat:
        steps.append(("pieces", cut.relabel_at_running_starts(pieces, F.col("breaks"))))
    steps.append(("typed", cut.typed_chunks(pieces, F.col("language"))))
    steps.append(("chunks", cut.merge_variables(F.col("typed"), F.col("lines"))))
    return steps


def chunk_files(files: DataFrame, *, compat: bool = False, max_lines: int = fv.MAX_CHUNK_LINES,
                merge_small: bool = False, overlap: bool = False, timestamp: int | None = None) -> DataFrame:
    """Chunk rows of files with ``file_path``, ``language`` and ``text``.

    Files of other languages and blank files yield no rows. ``compat=True``
    recounts start lines from the kept pieces, which shifts them after a
    dropped blank region; ``merge_small`` and ``overlap`` are the two steps
    that are off by default.
    """
    # Blank files need no filter of their own: their only piece is blank.
    code = files.where(F.col("language").isin(*fv.CHUNKABLE_EXTENSIONS))
    scanned = scan_syntax(code.select("file_path", "language", "text"), compat=compat)
    staged = apply_steps(scanned, _cut_steps(compat, max_lines, merge_small, overlap))
    return cut.chunk_rows(staged, timestamp=timestamp)


def chunk_errors(files: DataFrame) -> DataFrame:
    """Files that cannot be chunked, with the reason."""
    bad = files.where(~F.col("language").isin(*fv.CHUNKABLE_EXTENSIONS))
    return bad.select("file_path", F.concat(
        F.lit("Unsupported file extension: "), "language").alias("error"))


def fallback_chunks(files: DataFrame, max_lines: int = fv.MAX_CHUNK_LINES) -> DataFrame:
    """Plain pieces of ``max_lines`` lines, typed by content."""
    staged = files.withColumn("lines", cut.split_lines(F.col("text")))
    staged = staged.withColumn("pieces", cut.fixed_cut(F.col("lines"), max_lines))
    staged = staged.withColumn("chunks", cut.typed_chunks(F.col("pieces"), F.col("language")))
    return cut.chunk_rows(staged, timestamp=0)
