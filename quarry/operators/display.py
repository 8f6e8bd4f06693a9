"""Shaping hits for display: passages, unit views, declared names, blocks and record lines."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import DECLARERS, MODIFIERS, clip, quoted_path
from quarry.operators.finalize import tokens as tokens_of

_WORD = re.compile(r"\w+")
_SET = re.compile(r"[ \t]*=(?![=>~])")


def declared_names(text: str) -> list[str]:
    """The names right after a declarer, modifiers skipped, once each in order."""
    found, waiting = [], False
    for w in _WORD.findall(text):
        if w in DECLARERS:
            waiting = True
        elif waiting and w not in MODIFIERS:
            if not w.isdigit() and w not in found:
                found.append(w)
            waiting = False
    return found


def declaration_tokens(text: str) -> list[str]:
    """The distinct tokens at declaration sites: in the head of a declaration, in its parameter list, or left of a
    plain equals sign."""
    found: dict[str, None] = {}
    depth, parameters, in_head, at = 0, None, False, 0
    for m in _WORD.finditer(text):
        for c in text[at : m.start()]:
            if c in "([":
                if c == "(" and in_head and parameters is None:
                    parameters = depth
                in_head = in_head and c != "("
                depth += 1
            elif c in ")]":
                depth -= 1
                parameters = None if parameters is not None and depth <= parameters else parameters
            elif c in "=;{},\n":
                in_head = False
        at = m.end()
        if m[0] in DECLARERS:
            in_head = True
        elif in_head or parameters is not None and depth > parameters or _SET.match(text, at):
            found.update(dict.fromkeys(tokens_of(m[0])))
    return list(found)


def declared(chunks: DataFrame) -> DataFrame:
    """path, start_line, tokens: declaration tokens of each chunk."""

    def run(stream):
        for pdf in stream:
            yield pd.DataFrame({"path": pdf.path, "start_line": pdf.start_line, "tokens": [declaration_tokens(b or "") for b in pdf.body]})

    return chunks.select("path", "start_line", "body").mapInPandas(run, "path string, start_line int, tokens array<string>")


def passage(lines: list[str], at: int, budget: int = 800, extra: int = 12) -> tuple[int, int]:
    """The span around line at, grown after and then before in turn while its lines and extra for each fit budget; the
    line itself is always in."""
    low = high = at
    left = budget - len(lines[at]) - extra
    while True:
        grown = False
        if high + 1 < len(lines) and len(lines[high + 1]) + extra <= left:
            high += 1
            left -= len(lines[high]) + extra
            grown = True
        if low > 0 and len(lines[low - 1]) + extra <= left:
            low -= 1
            left -= len(lines[low]) + extra
            grown = True
        if not grown:
            return low, high


def passage_lines(lines: int, at: int, n: int) -> tuple[int, int]:
    """n lines around line at, one more after than before if n is even."""
    low = max(0, at - (n - 1) // 2)
    return low, min(lines - 1, low + n - 1)


_CLOSER = re.compile(r"^\s*[\]})]+[;,]?\s*$|^\s*end\s*$")
_OPENER = re.compile(r"^\s*[\[{(]+\s*$")
_COMMENT = re.compile(r"^\s*(?:///?|//!|/\*|\*|#|--)")
_FLOW = re.compile(r"^\s*(?:}?\s*else|if|for|while|switch|case|match|try|catch|except|finally|return|with|do)\b")


def _indent(line: str) -> int:
    return sum(4 if c == "\t" else 1 for c in line[: len(line) - len(line.lstrip())])


def unit_view(lines: list[str], first: int, last: int, path: str = "", gap: int = 3, longest: int = 240) -> list[tuple[int, str]]:
    """The rows (index, text) that show lines first..last as one unit: edges without blank or bracket rows, cut at the
    unit's end, under the heads that hold it, with its closing row and short gaps filled."""
    while first < last and (not lines[first].strip() or _CLOSER.match(lines[first])):
        first += 1
    while last > first and (not lines[last].strip() or _OPENER.match(lines[last])):
        last -= 1
    opening = _indent(lines[first])
    for i in range(first + 1, last + 1):
        if _CLOSER.match(lines[i]) and _indent(lines[i]) < opening:
            last = i - 1
            break
    shown = set(range(first, last + 1))
    anchor = min((_indent(lines[i]) for i in shown if lines[i].strip()), default=0)
    if lines[first].lstrip().startswith("*") and not lines[first].lstrip().startswith("*/"):
        above = next((i for i in range(first - 1, max(-1, first - 13), -1) if lines[i].lstrip().startswith("/*")), None)
        if above is not None:
            shown |= {i for i in {above, *range(max(above, first - 2), first)} if i == above or len(lines[i]) <= longest}
    heads, level, i = [], anchor, first - 1
    while i >= 0 and level > 0 and len(heads) < 2:
        x = lines[i]
        if x.strip() and _indent(x) < level and not (_COMMENT.match(x) or _CLOSER.match(x) or _OPENER.match(x)):
            level = _indent(x)
            if not _FLOW.match(x):
                heads.append(i)
        i -= 1
    known = "".join(tokens_of(path))
    if heads:
        shown.add(heads[0])
        if heads[0] + 1 < first and re.match(r'^\s*(?:"""|\'\'\'|///|//!)', lines[heads[0] + 1]):
            shown.add(heads[0] + 1)
        shown |= {h for h in heads[1:] if any(t not in known for t in tokens_of(lines[h]) if t not in DECLARERS)}
    if last + 1 < len(lines) and _CLOSER.match(lines[last + 1]) and _indent(lines[last + 1]) <= anchor:
        shown.add(last + 1)
    rows = sorted(shown)
    for a, b in zip(rows, rows[1:], strict=False):
        if 1 < b - a <= gap + 1 and all(len(lines[i]) <= longest for i in range(a + 1, b)):
            shown |= set(range(a + 1, b))
    return [(i, lines[i]) for i in sorted(shown)]


def dedented(rows: list[str], width: int = 2) -> list[str]:
    """Rows without their common indent, their own in steps of width."""
    depths = [_indent(r) for r in rows if r.strip()]
    if not depths:
        return ["" for _ in rows]
    base = min(depths)
    step = math.gcd(*(d - base for d in depths)) or 1
    return [" " * ((_indent(r) - base) // step * width) + r.lstrip() if r.strip() else "" for r in rows]


def materialized(hits: DataFrame, files: DataFrame, chars: int = 800, unit: bool = True) -> DataFrame:
    """hits with lines (a passage of chars around the hit's line), lines_from, defines (names declared in the chunk)
    and unit_rows. Hits whose file is gone are left out."""
    from quarry.sources.corpus import line_array

    names, kept = hits.columns, hits.schema.toDDL()
    have = hits.join(files.select("path", line_array(F.col("text")).alias("_lines")), "path")
    rows = "array<struct<line: int, text: string>>"
    out = f"{kept}, lines array<string>, lines_from int, defines array<string>, unit_rows {rows}"

    def run(stream):
        for pdf in stream:
            place = pdf.columns.get_loc("_lines")
            cols = {"lines": [], "lines_from": [], "defines": [], "unit_rows": []}
            for h in pdf.itertuples(index=False):
                ls = list(h[place])
                at = min(max(h.line - 1, 0), len(ls) - 1)
                a, b = passage(ls, at, chars) if ls else (0, -1)
                cols["lines"].append(ls[a : b + 1])
                cols["lines_from"].append(a + 1)
                cols["defines"].append(declared_names("\n".join(ls[h.chunk_start_line - 1 : h.chunk_end_line])))
                last = min(h.end_line, len(ls)) - 1
                cols["unit_rows"].append([{"line": i + 1, "text": t} for i, t in unit_view(ls, min(h.start_line - 1, last), last, h.path)] if unit and ls else [])
            yield pdf.drop(columns="_lines").assign(**cols)[[*names, *cols]]

    return have.select(*names, "_lines").mapInPandas(run, out)


def block(path: Column, rows: Column) -> Column:
    """path:first-last, then a numbered line for each row, with an ellipsis where lines are left out."""
    numbered = F.transform(rows, lambda r, i: F.concat(F.when((i > 0) & (F.get(rows, i - 1)["line"] + 1 < r["line"]), F.lit("⋮\n")).otherwise(F.lit("")), r["line"].cast("string"), F.lit(":  "), r["text"]))
    head = F.concat(quoted_path(path), F.lit(":"), F.get(rows, F.lit(0))["line"].cast("string"), F.lit("-"), F.element_at(rows, -1)["line"].cast("string"))
    return F.concat_ws("\n", head, F.array_join(numbered, "\n"))


def record(path: Column, line: Column, text: Column, width: int = 200) -> Column:
    """path:line:text, clipped."""
    return F.concat_ws(":", quoted_path(path), line.cast("string"), clip(F.ltrim(text), width))


def json_lines(hits: DataFrame) -> DataFrame:
    """One JSON object a hit; absent fields are left out, not null."""
    return hits.select(F.to_json(F.struct(*[clip(F.ltrim("text")).alias("text") if c == "text" else F.col(c) for c in hits.columns])).alias("value"))
