"""Unified diffs as rows: hunks, numbered lines, reasons for skipping, token costs, chunks.

What needs no running numbers is computed on arrays inside a file's own row, without a shuffle. For numbered lines, whole
patches are exchanged once by file and exploded there; all windows share that exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkyard.functions import text as T
from hunkyard.functions.arrays import rows_of
from hunkyard.operators.prefix import running_before

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
LEAST_BUDGET = 256
CONTEXT_LINES = 6
FRAME_TOKENS = 19
COLUMNS_LINE = 6
CONTEXT_HEADING = 10
_REST = 1_000_000_000


def patch_lines(files: DataFrame, key: str = "diff_id", patch: str = "patch") -> DataFrame:
    """``key, hunk_no, pos, line, is_header`` of every patch line from the first hunk header on.

    Whole patches are exchanged by file before they are exploded, which moves less than their numbered lines would; all
    windows by file or hunk then need no further exchange.
    """
    each = files.select(key, patch).repartition(key).select(key, F.posexplode(T.lines(F.col(patch))).alias("pos", "line")).withColumn("is_header", F.rlike("line", F.lit(HUNK)))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("hunk_no", F.sum(F.col("is_header").cast("int")).over(w).cast("int")).where("hunk_no > 0")


def _header(n: int, default: int | None = None) -> Column:
    c = F.regexp_extract("line", HUNK, n)
    return F.try_to_number(c, F.lit("9999999999")).cast("bigint") if default is None else F.when(c == "", F.lit(default).cast("bigint")).otherwise(F.try_to_number(c, F.lit("9999999999")).cast("bigint"))


def numbered_lines(files: DataFrame, key: str = "diff_id", patch: str = "patch") -> DataFrame:
    """``key, hunk_no, pos, kind, old_line, new_line, line`` of each hunk line, its header included as kind ``@``.

    A line with + counts on the new side, with - on the old one, with a backslash on none, any other on both. The side
    a line is not on has a null number.
    """
    s = patch_lines(files, key, patch)
    first = F.substring("line", 1, 1)
    s = s.withColumn("kind", F.when(F.col("is_header"), "@").when(first == "\\", "\\").when(first.isin("+", "-"), first).otherwise(" "))
    by = Window.partitionBy(key, "hunk_no")
    upto = by.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    old_at = F.max(F.when(F.col("is_header"), _header(1))).over(by) + F.coalesce(F.sum(F.when(F.col("kind").isin("-", " "), 1).otherwise(0)).over(upto), F.lit(0))
    new_at = F.max(F.when(F.col("is_header"), _header(3))).over(by) + F.coalesce(F.sum(F.when(F.col("kind").isin("+", " "), 1).otherwise(0)).over(upto), F.lit(0))
    return s.select(key, "hunk_no", "pos", "kind", F.when(F.col("kind").isin("-", " "), old_at).alias("old_line"), F.when(F.col("kind").isin("+", " "), new_at).alias("new_line"), "line")


def hunked(files: DataFrame, keep: list[str], patch: str = "patch") -> DataFrame:
    """``keep, hs``: the hunks of each patch as an array of hunk_no, header, body (lines); text before them is dropped.

    Everything that needs no running numbers is computed on this array inside the file's own row, without a shuffle.
    Lines and places of headers are columns of their own, so that they are found once a file and not once a hunk.
    """
    f = files.select(*keep, T.lines(F.col(patch)).alias("__ls"))
    f = f.select(*keep, "__ls", F.filter(F.transform("__ls", lambda x, i: F.when(F.rlike(x, F.lit(HUNK)), i)), lambda i: i.isNotNull()).alias("__at"))
    one = lambda p, k: F.struct((k + 1).alias("hunk_no"), F.get("__ls", p).alias("header"), F.slice("__ls", p + 2, F.coalesce(F.get("__at", k + 1), F.size("__ls")) - p - 1).alias("body"))
    return f.select(*keep, F.transform("__at", one).alias("hs"))


def _number(header: Column, n: int, default: int | None = None) -> Column:
    c = F.regexp_extract(header, HUNK, n)
    value = F.try_to_number(c, F.lit("9999999999")).cast("bigint")
    return value if default is None else F.when(c == "", F.lit(default).cast("bigint")).otherwise(value)


def _count(body: Column, test) -> Column:
    return F.size(F.filter(body, test)).cast("bigint")


def hunks(files: DataFrame, key: str = "diff_id", patch: str = "patch") -> DataFrame:
    """One row for each hunk: starts and counts (a missing count is 1) and its lines by kind."""
    h = rows_of(hunked(files, [key], patch), [key], "hs", "hunk_no")
    head = F.col("header")
    return h.select(
        key,
        "hunk_no",
        _number(head, 1).alias("old_start"),
        _number(head, 2, 1).alias("old_count"),
        _number(head, 3).alias("new_start"),
        _number(head, 4, 1).alias("new_count"),
        F.size("body").cast("bigint").alias("n_lines"),
        _count(F.col("body"), lambda x: x.startswith("+")).alias("n_added"),
        _count(F.col("body"), lambda x: x.startswith("-")).alias("n_removed"),
    )


def _with_changes(hs: Column) -> Column:
    """Hunks with ``lo`` and ``hi``, the first and last added line on the new side, null without any."""

    def on_new_side(h: Column, upto: Column) -> Column:
        return _number(h["header"], 3) + _count(F.slice(h["body"], F.lit(1), upto - 1), lambda x: ~x.startswith("-") & ~x.startswith("\\"))

    def one(h: Column) -> Column:
        plus = F.transform(h["body"], lambda x: x.startswith("+"))
        first = F.array_position(plus, F.lit(True)).cast("int")
        last = F.size(plus) + 1 - F.array_position(F.reverse(plus), F.lit(True)).cast("int")
        some = first > 0
        return F.struct(h["hunk_no"].alias("hunk_no"), h["header"].alias("header"), h["body"].alias("body"), F.when(some, on_new_side(h, first)).alias("lo"), F.when(some, on_new_side(h, last)).alias("hi"))

    return F.transform(hs, one)


def split_diff(texts: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep, file_no, file_path, patch`` of each file of a whole diff text, as a file or ``git diff`` gives it. No shuffle.

    A file begins at its ``diff --git`` line; its path is that of the new side, or of the old one where it was removed.
    The patch is what follows the two file lines. Text before the first file, and files without any, are left out.
    """
    parts = F.slice(F.split(F.concat(F.lit("\n"), F.col(text)), r"\n(?=diff --git )"), 2, _REST)
    new, old = r"(?m)^\+\+\+ b/(.*)$", r"(?m)^--- a/(.*)$"
    name = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, new, 1), F.lit("")), F.nullif(F.regexp_extract(x, old, 1), F.lit("")))
    body = lambda x: F.regexp_replace(F.regexp_extract(x, r"(?s)\A.*?\n\+\+\+ [^\n]*\n(.*)\z", 1), r"\n\z", "")
    each = F.transform(parts, lambda x, i: F.struct((i + 1).alias("file_no"), name(x).alias("file_path"), body(x).alias("patch")))
    return rows_of(texts, keep, each, "file_path")


def with_added(files: DataFrame, keep: list[str], patch: str = "patch") -> DataFrame:
    """``keep, added``: the numbers of the lines that the symbol index counts as added, each once, as an array. No shuffle.

    Another rule than in :func:`numbered_lines`: +++ and --- lines are no additions or removals, and a line with a
    backslash moves the counter on.
    """

    def step(a: Column, x: Column) -> Column:
        add = x.startswith("+") & ~x.startswith("+++")
        cut = x.startswith("-") & ~x.startswith("---")
        return F.struct((a["at"] + F.when(cut, 0).otherwise(1)).alias("at"), F.when(add, F.array_append(a["out"], a["at"])).otherwise(a["out"]).alias("out"))

    start = lambda h: F.struct(_number(h["header"], 3).alias("at"), F.array().cast("array<bigint>").alias("out"))
    each = F.transform("hs", lambda h: F.aggregate(h["body"], start(h), step, lambda a: a["out"]))
    return hunked(files, keep, patch).select(*keep, F.array_distinct(F.flatten(each)).alias("added"))


def added_line_numbers(files: DataFrame, key: str = "diff_id", patch: str = "patch") -> DataFrame:
    """``key, new_line`` of the lines of :func:`with_added`, for unique keys."""
    each = F.transform("added", lambda n: F.struct(n.alias("new_line"), F.lit(True).alias("there")))
    return rows_of(with_added(files, [key], patch), [key], each, "there").select(key, "new_line")


def new_sides(hs: Column) -> Column:
    """Hunks as hunk_no, first (the number of the first line on the new side) and hay (the lines there as compared)."""

    def one(h: Column) -> Column:
        there = F.filter(h["body"], lambda x: ~x.startswith("-") & ~x.startswith("\\"))
        body = lambda x: T.normal_line(F.when(F.rlike(x, F.lit(r"^[ +]")), F.substring(x, 2, _REST)).otherwise(x))
        return F.struct(h["hunk_no"].alias("hunk_no"), _number(h["header"], 3).alias("first"), F.transform(there, body).alias("hay"))

    return F.transform(hs, one)


def skip_reason(path: Column, status: Column, patch: Column) -> Column:
    """Why a file is left out of a review, the first reason that holds, or null."""
    header = rf"(?:\A|{T.LINE_END})@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"
    has_hunk = F.rlike(patch, F.lit(header))
    adds = F.rlike(patch, F.lit(rf"(?s){header}.*?(?:{T.LINE_END})\+"))
    hit = T.first_match(path, T.IGNORED_PATHS)
    return (
        F.when(hit.isNotNull(), F.concat(F.lit("ignored by pattern: "), hit))
        .when(status == "removed", F.lit("removed file"))
        .when(F.coalesce(F.regexp_replace(patch, r"[\s\p{Z}]", ""), F.lit("")) == "", F.lit("empty patch"))
        .when(~has_hunk, F.lit("no parseable hunks"))
        .when(~adds, F.lit("no added or modified lines"))
    )


def _context(h: Column, whole: Column, context: int) -> tuple[Column, Column]:
    """First and last line of the whole file shown around a hunk."""
    return F.greatest(h["lo"] - context, F.lit(1)), F.least(h["hi"] + context, F.size(whole).cast("bigint"))


def hunk_context(files: DataFrame, context: int = CONTEXT_LINES, key: str = "diff_id") -> DataFrame:
    """``key, hunk_no, first_line, last_line``: the lines of the whole file shown around a hunk's changes."""
    f = hunked(files, [key, "full_content"]).select(key, "hs", T.lines(F.col("full_content")).alias("whole"))
    first = lambda h: _context(h, F.col("whole"), context)[0].alias("first_line")
    last = lambda h: _context(h, F.col("whole"), context)[1].alias("last_line")
    near = F.transform(_with_changes(F.col("hs")), lambda h: F.struct(h["hunk_no"].alias("hunk_no"), F.when(h["lo"].isNotNull() & (F.size("whole") > 0), first(h)).alias("first_line"), last(h)))
    return rows_of(f, [key], near, "first_line")


def _costs(h: Column, whole: Column, context: int) -> Column:
    """The tokens of each line that a hunk is shown as, in order.

    Tokens never reach over white space, so costs add up: header, heading of the columns, diff lines with two tokens
    for number and mark, and the surrounding lines of the whole file with their heading.
    """
    body = F.transform(h["body"], lambda x: F.when(x.startswith("\\"), T.tokens(x)).otherwise(T.tokens(F.when(F.rlike(x, F.lit(r"^[ +-]")), F.substring(x, 2, _REST)).otherwise(x)) + 2))
    first, last = _context(h, whole, context)
    shown = F.coalesce(h["lo"].isNotNull() & (F.size(whole) > 0) & (first <= last), F.lit(False))
    near = F.slice(whole, F.when(shown, first).otherwise(1).cast("int"), F.when(shown, last - first + 1).otherwise(0).cast("int"))
    around = F.when(shown, F.concat(F.array(F.lit(CONTEXT_HEADING)), F.transform(near, lambda x: T.tokens(x) + 2))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(T.tokens(h["header"]), F.lit(COLUMNS_LINE)), body, around)


def hunk_costs(files: DataFrame, keep: list[str], context: int = CONTEXT_LINES) -> DataFrame:
    """``keep, costs``: for each file an array of hunk_no, the costs of its lines in order, and their sum."""
    f = hunked(files, [*keep, "full_content"]).select(*keep, "hs", T.lines(F.col("full_content")).alias("whole"))
    f = f.select(*keep, "whole", _with_changes(F.col("hs")).alias("hs"))
    f = f.select(*keep, F.transform("hs", lambda h: F.struct(h["hunk_no"].alias("hunk_no"), _costs(h, F.col("whole"), context).alias("each"))).alias("cs"))
    return f.select(*keep, F.transform("cs", lambda c: F.struct(c["hunk_no"].alias("hunk_no"), c["each"].alias("each"), F.aggregate(c["each"], F.lit(0).cast("bigint"), lambda n, x: n + x).alias("cost"))).alias("costs"))


def _frame() -> Column:
    return F.lit(FRAME_TOKENS) + T.tokens(F.col("file_path")) + T.tokens(F.coalesce("language", F.lit("unknown"))) + T.tokens(F.col("status"))


def kept_files(files: DataFrame) -> DataFrame:
    """The files that are not skipped, with the tokens of the frame around their hunks; a null language is ``unknown``."""
    return files.where(skip_reason(F.col("file_path"), F.col("status"), F.col("patch")).isNull()).withColumn("frame", _frame())


def file_tokens(files: DataFrame, key: str = "diff_id") -> DataFrame:
    """``key, tokens``: the tokens of each file as shown in a review; 0 for skipped files. No shuffle."""
    kept = skip_reason(F.col("file_path"), F.col("status"), F.col("patch")).isNull()
    framed = files.withColumn("frame", _frame()).withColumn("is_kept", kept)
    # a skipped file keeps its row and loses its texts, so that nothing is counted for it
    bare = framed.select(key, "frame", "is_kept", F.when(F.col("is_kept"), F.col("patch")).alias("patch"), F.when(F.col("is_kept"), F.col("full_content")).alias("full_content"))
    c = hunk_costs(bare, [key, "frame", "is_kept"])
    total = F.aggregate("costs", F.lit(0).cast("bigint"), lambda n, x: n + x["cost"])
    return c.select(key, F.when(F.col("is_kept"), F.col("frame") + total).otherwise(0).cast("bigint").alias("tokens"))


def _folded(files: DataFrame, keep: list[str]) -> DataFrame:
    """``keep, done``: the chunks of each file that is not skipped, as an array of tokens (t) and whether a hunk was split (c)."""
    kept = kept_files(files).withColumn("budget", F.greatest(F.coalesce("max_tokens", F.lit(0)), F.lit(LEAST_BUDGET)))
    c = hunk_costs(kept, [*keep, "frame", "budget"])

    def item(hunk_no: Column, cost: Column, split: bool) -> Column:
        return F.struct(hunk_no.alias("hunk_no"), cost.cast("bigint").alias("cost"), F.lit(split).alias("split"))

    items = F.flatten(F.transform("costs", lambda h: F.when(F.col("frame") + h["cost"] > F.col("budget"), F.transform(h["each"], lambda x: item(h["hunk_no"], x, True))).otherwise(F.array(item(h["hunk_no"], h["cost"], False)))))
    arrays = c.select(*keep, "frame", "budget", items.alias("items"))
    fold = F.expr("""
        aggregate(items, named_struct('done', cast(array() as array<struct<t:bigint,c:boolean>>), 't', cast(-1 as bigint), 'c', false, 'h', -1),
          (a, x) -> if(a.t < 0, named_struct('done', a.done, 't', frame + x.cost, 'c', x.split, 'h', x.hunk_no),
                     if(a.t + x.cost > budget or a.c != x.split or (x.split and a.h != x.hunk_no),
                        named_struct('done', array_append(a.done, named_struct('t', a.t, 'c', a.c)), 't', frame + x.cost, 'c', x.split, 'h', x.hunk_no),
                        named_struct('done', a.done, 't', a.t + x.cost, 'c', a.c, 'h', a.h))),
          a -> if(a.t < 0, a.done, array_append(a.done, named_struct('t', a.t, 'c', a.c))))""")
    return arrays.select(*keep, fold.alias("done"))


def chunks(files: DataFrame, key: str = "diff_id") -> DataFrame:
    """``key, chunk_no, token_count, compressed`` of each file of ``files``, which also has ``max_tokens``.

    Hunks are packed in order while frame and hunks fit the budget; a hunk too large for one chunk is split by lines.
    The fold runs over the costs in the file's own row: no shuffle, and no text is collected.
    """
    each = F.transform("done", lambda c, i: F.struct((i + 1).alias("chunk_no"), c["t"].alias("token_count"), c["c"].alias("compressed")))
    return rows_of(_folded(files, [key]), [key], each, "chunk_no")


def chunk_counts(files: DataFrame, keep: list[str]) -> DataFrame:
    """``keep, n_chunks, tokens`` of each file that is not skipped, from the same fold, without exploding it."""
    f = _folded(files, keep)
    return f.select(*keep, F.size("done").cast("bigint").alias("n_chunks"), F.aggregate("done", F.lit(0).cast("bigint"), lambda n, x: n + x["t"]).alias("tokens"))


def cap_chunks(per_file: DataFrame, group: list[str], order: str) -> DataFrame:
    """``per_file`` (one row a file: n_chunks, max_chunks) with ``kept_chunks`` and whether the file is omitted in part.

    Files take slots in order; a file whose chunks do not all fit is omitted, as is every file after the last slot.
    """
    r = running_before(per_file, group, order, F.col("n_chunks"), "before")
    kept = F.greatest(F.least(F.col("n_chunks"), F.col("max_chunks") - F.col("before")), F.lit(0)).cast("bigint")
    return r.withColumn("kept_chunks", kept).withColumn("omitted", F.col("kept_chunks") < F.col("n_chunks")).drop("before")
