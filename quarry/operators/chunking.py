"""Cutting files into chunks of lines. A chunk is named by its path and first line, so ids need no global order."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.frames import held
from quarry.sources.corpus import line_array


@dataclass(frozen=True)
class ChunkParams:
    window: int = 32
    overlap: int = 8
    max_file_bytes: int = 4 << 20
    budget: int | None = None
    function_cap: int | None = None

    @property
    def stride(self) -> int:
        return max(self.window - min(self.overlap, self.window), 1)

    def with_window(self, window: int) -> ChunkParams:
        """Another window at the same share of overlap, without budget or function chunking."""
        return replace(self, window=window, overlap=window * self.overlap // max(self.window, 1), budget=None, function_cap=None)

    @property
    def tag(self) -> str:
        prefix = f"f{self.function_cap}" if self.function_cap else f"c{self.budget}" if self.budget else ""
        return f"{prefix}w{self.window}o{self.overlap}"


def _blank(body: Column) -> Column:
    return ~body.rlike(r"(?U)\S")


def _finish(spans: DataFrame) -> DataFrame:
    return held(spans, "body", F.concat_ws("\n", "lines")).where(~_blank(F.col("body"))).select("path", "start_line", "end_line", "body")


def window_chunks(files: DataFrame, params: ChunkParams = ChunkParams()) -> DataFrame:
    """path, start_line, end_line, body of windows of lines; the last ends with its file, blank ones are left out."""
    have = held(files, "ls", line_array(F.col("text"))).select("path", "ls", F.size("ls").alias("n")).where("n > 0")
    st, w = params.stride, params.window
    starts = F.filter(F.sequence(F.lit(0), F.col("n") - 1, F.lit(st)), lambda a: (a == 0) | (a - st + w < F.col("n")))
    cut = have.withColumn("a", F.explode(starts))
    return _finish(cut.select("path", (F.col("a") + 1).alias("start_line"), F.least(F.col("a") + w, "n").alias("end_line"), F.slice("ls", F.col("a") + 1, F.lit(w)).alias("lines")))


def gap_chunks(spans: DataFrame, window: int = 32) -> DataFrame:
    """Disjoint pieces of at most window lines of spans (path, start_line, end_line)."""
    at = F.explode(F.sequence("start_line", "end_line", F.lit(window))).alias("piece")
    return spans.where("start_line <= end_line").select("path", at, "end_line").select("path", F.col("piece").alias("start_line"), F.least(F.col("piece") + window - 1, "end_line").alias("end_line"))


def _spanned(files: DataFrame, cut) -> DataFrame:
    """files through cut(lines) -> [(start, end)] in 1-based lines, one file at a time."""
    have = held(files, "ls", line_array(F.col("text"))).select("path", "ls")

    def run(stream):
        for pdf in stream:
            rows = [(p, a, b) for p, ls in zip(pdf.path, pdf.ls, strict=True) if ls is not None for a, b in cut(list(ls))]
            yield pd.DataFrame(rows, columns=["path", "start_line", "end_line"])

    spans = have.mapInPandas(run, "path string, start_line int, end_line int")
    with_lines = spans.join(have, "path").withColumn("lines", F.slice("ls", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1))
    return _finish(with_lines)


def budget_spans(lines: list[str], params: ChunkParams) -> list[tuple[int, int]]:
    """Windows that end once they hold `budget` characters other than white space, overlapping by the same share."""
    budget = max(params.budget or 1, 1)
    keep_back = budget * params.overlap // max(params.window, 1)
    sizes = [sum(not c.isspace() for c in line) for line in lines]
    out, start = [], 0
    while start < len(lines):
        end, held = start, 0
        while end < len(lines) and (end == start or held < budget):
            held += sizes[end]
            end += 1
        out.append((start + 1, end))
        if end >= len(lines):
            break
        back, left = end, 0
        while back > start + 1 and left + sizes[back - 1] <= keep_back and left < keep_back:
            back -= 1
            left += sizes[back]
        start = max(back, start + 1)
    return out


def budget_chunks(files: DataFrame, params: ChunkParams) -> DataFrame:
    return _spanned(files, lambda ls: budget_spans(ls, params))


#: Declarations by shape, and lines that lead one.
_DECLARES = re.compile(r"^\s*(?:(?:export|default|pub(?:\([^)]*\))?|public|private|protected|static|final|abstract|async|unsafe|extern(?:\s+\"[^\"]*\")?|inline|const)\s+)*(?:def|fn|func|function\*?|struct|enum|trait|interface|class|type)\s+[A-Za-z_]\w*|^(?:[A-Za-z_][\w:<>*&,\[\] ]*\s+[*&]?)?[A-Za-z_~]\w*\s*\([^;]*\)\s*(?:const\s*)?\{\s*$")
_CONTAINER = re.compile(r"^\s*(?:[a-z]+\s+)*(?:class|impl|module|mod|namespace|interface)\b")
_LEADS = re.compile(r"^\s*(?:///|//!|//|/\*|\*|#|@)")


def definition_end(lines: list[str], at: int) -> int:
    """The last line of the declaration at a line: by braces if its head opens one, else by indent."""
    depth, opened = 0, False
    for i in range(at, len(lines)):
        code = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*", "", lines[i])
        depth += code.count("{") - code.count("}")
        opened = opened or "{" in code
        if opened and depth <= 0:
            return i
        if not opened and (code.rstrip().endswith((":", ";")) or i - at >= 3):
            break
    indent, end = len(lines[at]) - len(lines[at].lstrip()), at
    for i in range(at + 1, len(lines)):
        if lines[i].strip():
            if len(lines[i]) - len(lines[i].lstrip()) <= indent:
                break
            end = i
    return end


def definition_spans(lines: list[str], cap: int, window: int) -> list[tuple[int, int]]:
    """Declarations of at most cap lines with the comments that lead them; short ones join what touches them; the
    lines between are cut into windows. Containers and longer declarations are searched for those inside. Files
    whose braces don't balance fall back to nothing."""
    if sum(x.count("{") - x.count("}") for x in lines):
        return []
    units, at, floor = [], 0, 0
    while at < len(lines):
        if _DECLARES.search(lines[at]):
            end = definition_end(lines, at)
            start, blanks = at, 0
            while start > floor and at - start < 20:
                above = lines[start - 1]
                if not above.strip():
                    blanks += 1
                    if blanks > 1 or start - 2 < floor or not _LEADS.match(lines[start - 2]):
                        break
                elif not _LEADS.match(above):
                    break
                start -= 1
            if end - start + 1 <= cap and not _CONTAINER.match(lines[at]):
                units.append([start, end])
                at = floor = end + 1
                continue
        at += 1
    merged: list[list[int]] = []
    for a, b in units:
        if merged and merged[-1][1] + 1 == a and merged[-1][1] - merged[-1][0] + 1 < 5 and b - merged[-1][0] + 1 <= cap:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in [*merged, [len(lines), len(lines)]]:
        out += [(i + 1, min(i + window, a)) for i in range(at, a, window)]
        if a < len(lines):
            out.append((a + 1, b + 1))
        at = b + 1
    return out


def definition_chunks(files: DataFrame, params: ChunkParams = ChunkParams(function_cap=96)) -> DataFrame:
    """Chunks on declarations, read by shape (there is no parser), and line windows where a file has none."""
    w, st = params.window, params.stride

    def cut(lines: list[str]) -> list[tuple[int, int]]:
        found = definition_spans(lines, params.function_cap or 96, w)
        return found or [(a + 1, min(a + w, len(lines))) for a in range(0, len(lines), st) if a == 0 or a - st + w < len(lines)]

    return _spanned(files, cut)


def chunks(files: DataFrame, params: ChunkParams = ChunkParams()) -> DataFrame:
    files = files.where(F.col("size") <= params.max_file_bytes)
    if params.function_cap:
        return definition_chunks(files, params)
    return budget_chunks(files, params) if params.budget else window_chunks(files, params)


def doc_text(path: Column, body: Column) -> Column:
    """What the indexes see of a chunk: its path, then its lines."""
    return F.concat_ws("\n", path, body)
