"""Snippets found again in a diff or a file, and patches applied."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkyard.functions import text as T
from hunkyard.functions.arrays import rows_of
from hunkyard.operators import diff as D
from hunkyard.operators.colocate import map_groups


def needle(code: Column) -> Column:
    """The lines of a snippet as compared: normalised, blank ones dropped."""
    return F.filter(F.transform(T.lines(code), T.normal_line), lambda x: x != "")


def first_match(hay: Column, find: Column) -> Column:
    """The first position from 1 at which all lines of ``find`` follow each other in ``hay``, or null."""
    n, m = F.size(hay), F.size(find)
    starts = F.when((n >= m) & (m > 0), F.sequence(F.lit(1), F.greatest(n - m + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    same = lambda i: (F.get(hay, i - 1) == F.get(find, F.lit(0))) & (F.slice(hay, i, F.greatest(m, F.lit(1))) == find)
    return F.get(F.filter(starts, same), F.lit(0))


def locate(snippets: DataFrame, files: DataFrame) -> DataFrame:
    """``snippet_id, start_line, end_line, source`` of each snippet that is found, in new-file lines.

    ``snippets``: snippet_id, diff_id, code; ``files``: diff_id, patch, full_content. The new side of the hunks comes
    first, in order; the whole file is the fallback. Blank lines of the snippet are dropped but not those of the file.
    """
    want = snippets.select("snippet_id", F.col("diff_id").alias("sd"), needle(F.col("code")).alias("find"))
    j = want.join(files.select("diff_id", "patch", "full_content"), F.col("sd") == F.col("diff_id"))
    # columns that are looked at once a line are used twice each, so that they are made once a row
    h = D.hunked(j, ["snippet_id", "find", "full_content"]).select("snippet_id", "find", "full_content", D.new_sides(F.col("hs")).alias("sides"))
    placed = F.transform("sides", lambda s: F.struct((s["first"] - 1 + first_match(s["hay"], F.col("find"))).alias("s"), s["hunk_no"].alias("hunk_no")))
    h = h.select("snippet_id", "find", "full_content", F.get(F.filter(placed, lambda p: p["s"].isNotNull()), F.lit(0))["s"].alias("in_hunk"))
    hay = F.when(F.col("in_hunk").isNull(), F.transform(T.lines(F.col("full_content")), T.normal_line))
    h = h.select("snippet_id", "find", "in_hunk", hay.alias("hay"))
    h = h.select("snippet_id", "find", "in_hunk", F.coalesce("in_hunk", first_match(F.col("hay"), F.col("find")).cast("bigint")).alias("s"))
    place = F.struct(F.col("s").alias("start_line"), (F.col("s") + F.size("find") - 1).alias("end_line"), F.when(F.col("in_hunk").isNotNull(), "diff_hunk").otherwise("full_content").alias("source"))
    return rows_of(h, ["snippet_id"], F.array(place), "start_line")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}\x1c-\x1f\x{85}]+|[\s\p{Z}\x1c-\x1f\x{85}]+$", "")


def apply_first(code: Column, original: Column, patched: Column) -> tuple[Column, Column]:
    """What becomes of one patch, and the new text: the first place of the trimmed original is replaced."""
    o, p = _strip(F.coalesce(original, F.lit(""))), _strip(F.coalesce(patched, F.lit("")))
    at = F.position(o, code)
    state = F.when(o == "", "empty").when(o == p, "no change").when(at > 0, "applied").otherwise("not found")
    new = F.when(state == "applied", F.concat(F.substring(code, F.lit(1), at - 1), p, F.substring(code, at + F.length(o), F.lit(1_000_000_000))))
    return state, new


def _fuzzy(lines: list[str], snippet: str, hint: int) -> tuple[int, int] | None:
    want = [x.strip() for x in snippet.splitlines() if x.strip()]
    if not want:
        return None
    for i in range(max(0, hint - 10), min(len(lines), hint + 10)):
        if i + len(want) <= len(lines) and all(lines[i + j].strip() == w for j, w in enumerate(want)):
            return i, i + len(want) - 1
    return None


def patch_text(code: str, patches: list[tuple[str | None, str | None, int | None]]) -> tuple[str, int, int]:
    """The text after its patches (original, patched, start line), how many were applied and how many warned of.

    Patches go from the last start line to the first, equal ones in their order; a null start line is 0. An original
    that is not found literally is sought by its trimmed lines near the start line and takes the indentation there.
    """
    applied = warned = 0
    for original, patched, start in sorted(patches, key=lambda p: -(p[2] or 0)):
        o, p = (original or "").strip(), (patched or "").strip()
        if not o or o == p:
            warned += 1
        elif o in code:
            code = code.replace(o, p, 1)
            applied += 1
        else:
            lines = code.splitlines()
            hit = _fuzzy(lines, o, start or 0)
            if hit is None:
                warned += 1
                continue
            head = lines[hit[0]]
            pad = head[: len(head) - len(head.lstrip())]
            new = p.splitlines()
            cut = min((len(x) - len(x.lstrip()) for x in new if x.strip()), default=0)
            lines[hit[0] : hit[1] + 1] = [pad + x[cut:] if x.strip() else "" for x in new]
            code = "\n".join(lines)
            code += "" if code.endswith("\n") else "\n"
            applied += 1
    return code, applied, warned


def apply_patches(files: DataFrame, patches: DataFrame) -> DataFrame:
    """``diff_id, applied, warned, new_content`` of each file with patches, which are applied one after the other.

    ``patches``: diff_id, ord, original, patched, start_line. A group is one file with its patches, bounded by that file.
    """
    code = files.select("diff_id", F.lit(-1).alias("ord"), F.col("full_content").alias("original"), F.lit(None).cast("string").alias("patched"), F.lit(None).cast("int").alias("start_line")).join(patches.select("diff_id").distinct(), "diff_id", "left_semi")
    rows = code.unionByName(patches.select("diff_id", "ord", "original", "patched", F.col("start_line").cast("int").alias("start_line")))

    def fn(t: pa.Table) -> pa.Table:
        cols = [t.column(c).to_pylist() for c in ("diff_id", "ord", "original", "patched", "start_line")]
        out: list[list] = [[], [], [], []]
        a = 0
        while a < len(cols[0]):
            b = a + 1
            while b < len(cols[0]) and cols[0][b] == cols[0][a]:
                b += 1
            group = sorted(zip(*(c[a:b] for c in cols[1:])), key=lambda r: r[0])
            base = next((r[1] for r in group if r[0] == -1), None)
            if base is not None:
                new, n, w = patch_text(base, [(r[1], r[2], r[3]) for r in group if r[0] != -1])
                for c, v in zip(out, (cols[0][a], n, w, new)):
                    c.append(v)
            a = b
        return pa.table({"diff_id": pa.array(out[0], pa.int64()), "applied": pa.array(out[1], pa.int32()), "warned": pa.array(out[2], pa.int32()), "new_content": pa.array(out[3], pa.string())})

    return map_groups(rows, ["diff_id"], fn, "diff_id bigint, applied int, warned int, new_content string")
