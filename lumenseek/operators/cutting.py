"""Cutting files into chunks, as array expressions over one row per file.

A file arrives as one row, so its lines, points and pieces stay arrays of
that row: no step here shuffles, and a plan of all of them is one narrow
stage. Sizes are bounded by the file, whose size the scan caps.

Array-valued steps are separate columns that each consumer mentions more than
once, which keeps Catalyst from inlining ``split`` into a lambda body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenseek import fixed_values as fv
from lumenseek.functions.text import WS_JAVA, is_blank, literal_map, trim_ws
from lumenseek.operators.arrays import let, part, running_sum, shifted_back, shifted_on


def split_lines(text: Column) -> Column:
    """Lines of a text, trailing empty ones kept."""
    return F.split(text, "\n", -1)


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def explode_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """One row per line with its 0-based number."""
    return files.select("*", F.posexplode(split_lines(F.col(text))).alias("line_no", "line")).drop(text)


# -- points of interest -----------------------------------------------------------

def group_imports(points: Column) -> Column:
    """Keep the first of each run of import/export points; anything else ends a run."""
    def in_block(p: Column) -> Column:
        return p["label"].isin("Import", "Export")

    # Pair every point with its predecessor, then drop the repeats.
    pairs = let(F.array_sort(points), lambda ordered: F.zip_with(ordered, shifted_back(ordered), lambda p, before: F.struct(
        p.alias("p"), F.coalesce(in_block(p) & in_block(before), F.lit(False)).alias("repeat"))))
    return F.transform(F.filter(pairs, lambda x: ~x["repeat"]), lambda x: x["p"])


def first_per_line(points: Column) -> Column:
    """The first point of every line, of points sorted by line."""
    pairs = let(points, lambda known: F.zip_with(known, shifted_back(known), lambda p, b: F.struct(
        p.alias("p"), F.coalesce(p["line"] == b["line"], F.lit(False)).alias("repeat"))))
    return F.transform(F.filter(pairs, lambda x: ~x["repeat"]), lambda x: x["p"])


def lift_over_comments(points: Column, comments: Column) -> Column:
    """Breakpoints moved up over the comment lines directly above them.

    Returns ``struct(line, label)`` sorted by line. Where several points end
    up on one line the lowest of them gives the label.
    """
    def lift(heads: Column) -> Column:
        def lifted(p: Column) -> Column:
            head = F.when(p["line"] > 0, F.get(heads, p["line"] - 1))
            return F.struct(F.coalesce(head, p["line"]).alias("line"), p["line"].alias("origin"), p["label"].alias("label"))

        return F.array_sort(F.transform(points, lifted))

    moved = F.when(F.size(comments) > 0, let(let(F.array_sort(F.array_distinct(comments)), _run_heads), lift)).otherwise(F.transform(
        points, lambda p: F.struct(p["line"].alias("line"), p["line"].alias("origin"), p["label"].alias("label"))))
    return let(moved, _last_per_line)


def _run_heads(lines: Column) -> Column:
    """By line number: the first line of the run of comment lines it is in, else NULL.

    One pass over sorted lines: gaps become NULLs, and a line's run is found by
    the running number of runs.
    """
    pairs = F.zip_with(lines, shifted_back(lines), lambda c, b: F.struct(
        c.alias("line"), (c - F.coalesce(b, F.lit(-1)) - 1).alias("gap"), (b.isNull() | (b != c - 1)).alias("opens")))

    def spread_out(rows: Column) -> Column:
        heads = F.transform(F.filter(rows, lambda r: r["opens"]), lambda r: r["line"])
        numbers = running_sum(F.transform(rows, lambda r: r["opens"].cast("int")))
        return let(heads, lambda known: F.flatten(F.zip_with(rows, numbers, lambda r, n: F.concat(
            F.array_repeat(F.lit(None).cast("int"), r["gap"]), F.array(F.get(known, n - 1))))))

    return let(pairs, spread_out)


def _last_per_line(moved: Column) -> Column:
    pairs = F.zip_with(moved, shifted_on(moved), lambda p, n: F.struct(
        p["line"].alias("line"), p["label"].alias("label"),
        F.coalesce(p["line"] == n["line"], F.lit(False)).alias("covered")))
    return F.transform(F.filter(pairs, lambda x: ~x["covered"]),
                       lambda x: F.struct(x["line"].alias("line"), x["label"].alias("label")))


# -- pieces: struct(start, label, lines) ------------------------------------------------

def _keep_filled(pieces: Column) -> Column:
    return F.filter(pieces, lambda p: ~is_blank(join_lines(p["lines"])))


def cut(lines: Column, breaks: Column) -> Column:
    """Pieces from each breakpoint to the next; an unlabelled one before the first.

    Blank pieces are dropped. Without breakpoints the file is one piece.
    """
    no_label = F.lit(None).cast("string")
    head = F.array(F.struct(F.lit(0).alias("line"), no_label.alias("label")))
    starts = F.when(F.coalesce(F.get(breaks, F.lit(0))["line"], F.lit(-1)) == 0, breaks).otherwise(
        F.concat(head, breaks))

    def between(all_starts: Column) -> Column:
        return F.zip_with(all_starts, shifted_on(all_starts), lambda b, after: F.struct(
            b["line"].alias("start"), b["label"].alias("label"),
            part(lines, b["line"], F.coalesce(after["line"], F.size(lines)) - b["line"]).alias("lines")))

    return _keep_filled(let(starts, between))


def _can_end(line: Column) -> Column:
    """A blank line, a closing brace, or a finished statement without 'for' or 'if' in it."""
    t = trim_ws(line)
    return (t.isin("", "}", "};")
            | (F.endswith(t, F.lit(";")) & ~F.contains(t, F.lit("for")) & ~F.contains(t, F.lit("if"))))


def split_points(lines: Column, cap: int, floor: int, look_back: int) -> Column:
    """Start offsets of the parts of an over-long piece, the first being 0.

    Every part but the last ends at the last line within ``look_back`` of the
    cap (yet ``floor`` from its start) that can end a part, else at the cap.
    """
    shortest = max(floor + 1, cap - look_back + 1, 1) if floor < cap else cap

    def walk(may_end: Column) -> Column:
        size = F.size(may_end)

        def step(offsets: Column, _: Column) -> Column:
            start = F.element_at(offsets, -1)
            end = start + cap
            first = F.greatest(start + floor, end - look_back)
            good = F.when(first <= end - 1, F.array_max(F.filter(
                F.sequence(first, end - 1), lambda i: F.get(may_end, i))))
            return F.when(size - start <= cap, offsets).otherwise(
                F.concat(offsets, F.array(F.coalesce(good + 1, end))))

        rounds = F.sequence(F.lit(1), F.ceil(size / shortest).cast("int"))
        return F.aggregate(rounds, F.array(F.lit(0)), step)

    return let(F.transform(lines, _can_end), walk)


def split_large(pieces: Column, cap: int = fv.MAX_CHUNK_LINES, floor: int = fv.MIN_CHUNK_LINES,
                look_back: int = fv.SPLIT_LOOK_BACK) -> Column:
    """Pieces of at most ``cap`` lines; only the first part keeps the label."""
    def parts(p: Column) -> Column:
        return let(split_points(p["lines"], cap, floor, look_back), lambda offsets: F.zip_with(
            offsets, shifted_on(offsets), lambda o, end: F.struct(
                (p["start"] + o).alias("start"), F.when(o == 0, p["label"]).alias("label"),
                part(p["lines"], o, F.coalesce(end, F.size(p["lines"])) - o).alias("lines"))))

    whole = ~F.exists(pieces, lambda p: F.size(p["lines"]) > cap)
    return F.when(whole, pieces).otherwise(_keep_filled(F.flatten(F.transform(pieces, lambda p: F.when(
        F.size(p["lines"]) <= cap, F.array(p)).otherwise(parts(p))))))


def fixed_cut(lines: Column, cap: int = fv.MAX_CHUNK_LINES) -> Column:
    """Plain pieces of ``cap`` lines, blank ones dropped."""
    last = F.floor((F.size(lines) - 1) / cap).cast("int")
    return _keep_filled(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        (i * cap).alias("start"), F.lit(None).cast("string").alias("label"),
        part(lines, i * cap, F.least(F.size(lines) - i * cap, F.lit(cap))).alias("lines"))))


def merge_small(pieces: Column, floor: int = fv.MIN_CHUNK_LINES) -> Column:
    """Join pieces under ``floor`` lines pairwise: with the next, the last with the one before."""
    def flags(sizes: Column) -> Column:
        """Whether a piece is joined to the one before: every second one after the start of a run of small pieces."""
        count = F.size(sizes)
        large = F.array_compact(F.transform(sizes, lambda n, i: F.when(n >= floor, i)))
        passed = running_sum(F.transform(sizes, lambda n: (n >= floor).cast("int")))
        before = let(passed, lambda known: F.zip_with(shifted_back(sizes), shifted_back(known), lambda n, k: F.struct(n.alias("n"), k.alias("k"))))

        def taken(x: Column, i: Column, big: Column) -> Column:
            run = F.coalesce(F.get(big, x["k"] - 1), F.lit(-1)) + 1
            last_small = (i == count - 1) & (i > 0) & (F.get(sizes, i) < floor)
            return F.coalesce((x["n"] < floor) & ((i - run) % 2 == 1), F.lit(False)) | last_small

        return let(large, lambda big: F.transform(before, lambda x, i: taken(x, i, big)))

    def joined(taken: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(taken) - 1), lambda i: ~F.get(taken, i))
        return let(heads, lambda hs: F.zip_with(hs, shifted_on(hs), lambda h, e: F.struct(
            F.get(pieces, h)["start"].alias("start"), F.get(pieces, h)["label"].alias("label"),
            F.flatten(F.transform(part(pieces, h, F.coalesce(e, F.size(taken)) - h),
                                  lambda p: p["lines"])).alias("lines"))))

    sizes = F.transform(pieces, lambda p: F.size(p["lines"]))
    return F.when(F.size(pieces) <= 1, pieces).otherwise(let(let(sizes, flags), joined))


def add_overlap(pieces: Column, lines: int = fv.OVERLAP_LINES) -> Column:
    """Prepend the last lines of the piece before to every piece but the first."""
    return F.zip_with(pieces, shifted_back(pieces), lambda p, b: F.struct(
        p["start"].alias("start"), p["label"].alias("label"),
        F.when(b.isNull(), p["lines"]).otherwise(F.concat(
            F.slice(b["lines"], F.greatest(F.size(b["lines"]) - lines + 1, F.lit(1)), F.lit(lines)),
            p["lines"])).alias("lines")))


def running_starts(pieces: Column) -> Column:
    """Start lines recounted from the kept pieces alone, so dropped blanks shift them."""
    sizes = F.transform(pieces, lambda p: F.size(p["lines"]))
    return F.when(F.size(pieces) == 0, F.array().cast("array<int>")).otherwise(F.zip_with(
        running_sum(sizes), sizes, lambda total, n: total - n))


def relabel_at_running_starts(pieces: Column, breaks: Column) -> Column:
    """Pieces at their recounted starts, labelled by what breaks there (compat form)."""
    kinds = "struct<line:int,piece:int,label:string>"
    marks = F.concat(F.transform(breaks, lambda b: F.struct(b["line"].alias("line"), F.lit(0).alias("piece"), b["label"].alias("label")).cast(kinds)),
                     F.transform(running_starts(pieces), lambda s: F.struct(
                         s.alias("line"), F.lit(1).alias("piece"), F.lit(None).cast("string").alias("label")).cast(kinds)))
    # Sorted by line, a piece comes right after the break on its line; there is at most one of each on a line.
    labelled = let(F.array_sort(marks), lambda m: F.filter(F.zip_with(m, shifted_back(m), lambda x, b: F.struct(
        x["piece"].alias("piece"), x["line"].alias("line"), F.when(b["line"] == x["line"], b["label"]).alias("label"))),
        lambda x: x["piece"] == 1))
    return F.zip_with(pieces, labelled, lambda p, x: F.struct(
        x["line"].alias("start"), x["label"].alias("label"), p["lines"].alias("lines")))


# -- chunk types ------------------------------------------------------------------------

def _per_line_pattern(pattern: str) -> str:
    return pattern.replace(r"[\s>]", f"[{WS_JAVA[1:-1]}>]").replace(r"\s", WS_JAVA)


def _any_line(lines: Column, regex: str) -> Column:
    return F.exists(lines, lambda line: line.rlike(regex))


def content_type(lines: Column, language: Column) -> Column:
    """Type by content: the first rule with a line that matches, else block."""
    out = F.when(F.lit(False), F.lit(""))
    for extensions, kind, patterns in fv.CONTENT_RULES:
        regex = "|".join(f"(?:{_per_line_pattern(p)})" for p in patterns)
        out = out.when(language.isin(*extensions) & _any_line(lines, regex), kind)
    return out.otherwise("block")


def syntax_type(label: Column) -> Column:
    """Chunk type of a syntax label; labels outside the table are blocks."""
    return F.coalesce(F.element_at(literal_map(fv.SYNTAX_TYPES), label), F.lit(fv.UNMAPPED_SYNTAX_TYPE))


# -- chunks: struct(start, end, type, text) ------------------------------------------------

def typed_chunks(pieces: Column, language: Column) -> Column:
    return F.transform(pieces, lambda p: F.struct(
        p["start"].alias("start"), (p["start"] + F.size(p["lines"]) - 1).alias("end"),
        F.when(p["label"].isNotNull(), syntax_type(p["label"])).otherwise(
            content_type(p["lines"], language)).alias("type"),
        trim_ws(join_lines(p["lines"])).alias("text")))


def merge_variables(chunks: Column, lines: Column, gap: int = fv.VARIABLE_MERGE_GAP) -> Column:
    """Runs of variable chunks at most ``gap`` lines apart become one chunk each.

    The text of a merged chunk is cut from the file again, lines in the gaps
    included.
    """
    pairs = F.zip_with(chunks, shifted_back(chunks), lambda c, b: F.coalesce(
        (c["type"] == "variable") & (b["type"] == "variable") & (c["start"] - b["end"] - 1 <= gap), F.lit(False)))
    heads = F.filter(F.transform(pairs, lambda joined, i: F.when(~joined, i)), lambda i: i.isNotNull())

    def island(h: Column, e: Column) -> Column:
        first, last = F.get(chunks, h), F.get(chunks, e - 1)
        text = trim_ws(join_lines(part(lines, first["start"], last["end"] - first["start"] + 1)))
        return F.struct(first["start"].alias("start"), last["end"].alias("end"),
                        first["type"].alias("type"),
                        F.when(e - h == 1, first["text"]).otherwise(text).alias("text"))

    merged = let(heads, lambda hs: F.zip_with(hs, shifted_on(hs), lambda h, e: island(
        h, F.coalesce(e, F.size(chunks)))))
    return F.when(F.size(chunks) <= 1, chunks).otherwise(merged)


def chunk_rows(files: DataFrame, chunks: str = "chunks", *, timestamp: int | None = None) -> DataFrame:
    """Chunk table rows (without vectors) from one array of chunks per file."""
    when = F.lit(timestamp).cast("long") if timestamp is not None else F.unix_millis(F.current_timestamp())
    # A plain explode makes the optimizer infer a size filter on the array and
    # push it below every step that built the array, repeating all of them.
    rows = files.select("file_path", "language", F.posexplode_outer(chunks).alias("pos", "c")).where(
        F.col("pos").isNotNull())
    start, end = F.col("c.start") + 1, F.col("c.end") + 1
    return rows.select(
        F.format_string("%s:%d-%d", "file_path", start, end).alias("id"), "file_path",
        start.alias("start_line"), end.alias("end_line"), F.col("c.text").alias("text"),
        F.col("c.type").alias("type"), "language", when.alias("timestamp"),
        F.col("pos").alias("chunk_index_in_file"))


def with_metadata(pieces: Column) -> Column:
    """Numbered pieces with 0-based line ranges recounted without blank gaps."""
    return F.transform(F.arrays_zip(pieces.alias("p"), running_starts(pieces).alias("s")), lambda x, i: F.struct(
        (i + 1).alias("chunk_number"), join_lines(x["p"]["lines"]).alias("code"),
        x["s"].alias("start_line"), (x["s"] + F.size(x["p"]["lines"]) - 1).alias("end_line")))


def consolidate(pieces: Column) -> Column:
    """The kept pieces joined back into one text."""
    return F.array_join(F.transform(pieces, lambda p: join_lines(p["lines"])), "\n")


def count_lines(text: Column) -> Column:
    return F.size(split_lines(text))
