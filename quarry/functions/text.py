"""Text functions as columns: code-aware tokens, path parts, globs, phrases, clipping, units."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where an identifier falls apart: after a lower-case letter or digit before an upper-case one, and before the last
#: capital of an acronym that begins a word.
_SEAM = r"(?<=[\p{Ll}0-9])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
#: What a text with any such place matches.
_SEAMED = r"[\p{Ll}0-9]\p{Lu}|\p{Lu}\p{Lu}\p{Ll}"

#: Keywords and filler words of common languages, by category.
KEYWORDS = frozenset("if else for while do switch case break continue return goto try catch finally throw new delete this super class struct enum union interface trait impl def fn func function let var const static public private protected void int long float double bool char string true false null none nil self import from use package module namespace extends implements".split())
EXTRA_KEYWORDS = frozenset("async await yield lambda with as in is not and or pass raise except elif unless until begin end then loop match where mut pub crate mod type typedef sizeof volatile extern inline register signed unsigned short virtual override final abstract template typename operator friend using".split())
LOW_SIGNAL = frozenset("get set data value values item items obj object tmp temp foo bar result res ret arg args param params key keys val idx index i j k n x y s str buf ptr list map node info ctx context name names id ids util utils helper helpers misc".split())
DECLARERS = frozenset("def fn func function class struct enum trait interface impl type typedef let var const val mod module namespace package union macro macro_rules sub proc method record static".split())
MODIFIERS = frozenset("pub async static const mut unsafe extern inline export default".split())


def text_tokens(text: Column, whole: bool = True) -> Column:
    """Lower-case tokens of two characters or more: the parts of each identifier, then, if it fell apart, itself."""

    def parts(word: Column) -> Column:
        split = F.split(word, _SEAM)
        split = F.when(word.rlike(_SEAM), F.concat(split, F.array(word)) if whole else split).otherwise(F.array(word))
        return F.when(word == F.lower(word), F.array(word)).otherwise(split)  # without a capital there is no seam

    long = lambda t: F.length(t) >= 2
    runs = F.split(text, r"[^\p{L}\p{N}]+")
    found = F.when(text.rlike(_SEAMED), F.flatten(F.transform(runs, parts))).otherwise(runs)
    return F.transform(F.filter(found, long), F.lower)


def word_ranges(text: Column) -> Column:
    """start, end of each run of letters, digits and underscores, in bytes of UTF-8, end exclusive; null of a null."""

    def every(texts: pa.Array) -> pa.Array:
        # flat arrays: eight bytes a word, where a list of dicts would take hundreds
        runs, counts = [], np.zeros(len(texts), np.int32)
        for i, scalar in enumerate(texts):
            text = scalar.as_py()
            if text:
                found = np.array([m.span() for m in re.finditer(r"\w+", text)], np.int32).reshape(-1, 2)
                if not text.isascii():
                    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
                    width = 1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000)
                    found = np.r_[0, np.cumsum(width, dtype=np.int32)].astype(np.int32)[found]
                runs.append(found)
                counts[i] = len(found)
        flat = np.concatenate(runs) if runs else np.zeros((0, 2), np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["start", "end"])
        ends = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
        return pa.ListArray.from_arrays(ends, pairs, mask=texts.is_null())

    return F.arrow_udf(every, "array<struct<start: int, end: int>>")(text)


def split_camel(word: Column) -> Column:
    return F.split(word, _SEAM)


def tail_segments(path: Column, n: int) -> Column:
    """The last n segments of a path."""
    return F.substring_index(path, "/", -n)


def under(path: Column, prefix: str) -> Column:
    """True of a path that is prefix or lies below it, on whole segments; the empty prefix holds everything."""
    prefix = prefix.strip("/")
    return F.lit(True) if prefix in ("", ".") else (path == prefix) | path.startswith(prefix + "/")


def glob_pattern(glob: str) -> tuple[bool, str]:
    """(keep, Java regex) of one ignore-style glob: a leading ! drops; a match of a folder holds what is below it;
    a glob without an inner slash matches at any depth."""
    keep = not glob.startswith("!")
    body = glob.lstrip("!").rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = [], 0
    while i < len(body):
        if body.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif body.startswith("**", i):
            out.append(".*")
            i += 2
        elif body[i] == "*":
            out.append("[^/]*")
            i += 1
        elif body[i] == "?":
            out.append("[^/]")
            i += 1
        elif body[i] == "[" and "]" in body[i + 1 :]:
            end = body.index("]", i + 1)
            inner = body[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]")
            i = end + 1
        else:
            out.append(re.escape(body[i]))
            i += 1
    return keep, f"^{'' if anchored else '(?:.*/)?'}{''.join(out)}(?:/.*)?$"


def glob_match(path: Column, globs: list[str]) -> Column:
    """The last glob that matches decides; without one, a path passes only if every glob drops."""
    rules = [glob_pattern(g) for g in globs]
    out = F.lit(not any(keep for keep, _ in rules))
    for keep, pattern in rules:
        out = F.when(path.rlike(pattern), F.lit(keep)).otherwise(out)
    return out


def split_phrases(raw: str, most: int = 8) -> list[str]:
    """The phrases of a query: split on single bars, plain or escaped; doubled bars never split; empty ones drop; if
    all are empty the query is one phrase; without a bar it is kept to the byte."""
    if "|" not in raw:
        return [raw]
    parts = re.split(r"(?<!\|)\\?\|(?!\|)", raw)
    kept = [p.strip() for p in parts if p.strip()]
    return kept[:most] if kept else [raw]


def phrase_array(raw: Column, most: int = 8) -> Column:
    """split_phrases as a column."""
    parts = F.filter(F.transform(F.split(raw, r"(?<!\|)\\?\|(?!\|)"), F.trim), lambda p: p != "")
    return F.when(~raw.contains("|") | (F.size(parts) == 0), F.array(raw)).otherwise(F.slice(parts, 1, most))


def parse_lines(text: str) -> tuple[int, int]:
    """A-B, A- or -B as an inclusive range of lines."""
    m = re.fullmatch(r"(\d*)-(\d*)", text.strip())
    if not m or not (m[1] or m[2]):
        raise ValueError(f"not a line range: {text!r}")
    low, high = int(m[1] or 1), int(m[2] or 2**31 - 1)
    if low > high:
        raise ValueError(f"empty line range: {text!r}")
    return low, high


def parse_top(text: str, most: int = 10_000) -> int:
    k = int(text)
    if not 1 <= k <= most:
        raise ValueError(f"k must be 1 to {most}")
    return k


def clip(text: Column, width: int = 200) -> Column:
    """At most width characters, and how many more there were."""
    more = F.format_string("%s [… +%d chars]", F.substring(text, 1, width), F.length(text) - width)
    return F.when(F.length(text) > width, more).otherwise(text)


def human(size: Column) -> Column:
    """A size in decimal units."""
    out = F.format_string("%d B", size.cast("long"))
    for limit, unit in ((1e3, "KB"), (1e6, "MB"), (1e9, "GB")):
        out = F.when(size >= limit, F.format_string(f"%.1f {unit}", size.cast("double") / limit)).otherwise(out)
    return out


def quoted_path(path: Column) -> Column:
    """A path in C-style quotes if it holds a control character, a double quote or a colon."""
    inner = F.regexp_replace(F.regexp_replace(path, r"(\\|\")", r"\\$1"), "\n", r"\\n")
    inner = F.regexp_replace(F.regexp_replace(inner, "\t", r"\\t"), "\r", r"\\r")
    return F.when(path.rlike(r"[\x00-\x1f\x7f\":]"), F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(path)


#: What each tier of prose rendering does: whole identifiers, keyword table (none, legacy, extended), only for whole
#: runs, low-signal words, declarations (none, only, boost), distinct; then the same of the query side that differs.
TIERS = {
    "split": {}, "split-whole": {"whole": True}, "split-nokw": {"kw": "legacy"}, "prune-kw": {"kw": "all"},
    "prune-lex": {"kw": "all", "low": True}, "prune-decl": {"kw": "all", "low": True, "decl": "only"},
    "prune-soft": {"kw": "all", "low": True, "decl": "boost"}, "prune-uniq": {"kw": "all", "low": True, "distinct": True},
    "prune-lex-sym": {"kw": "all", "low": True, "query_low": True}, "prune-uniq-sym": {"kw": "all", "low": True, "distinct": True, "query_low": True, "query_distinct": True},
    "prune-kw-pos": {"kw": "all", "pos": True}, "prune-kw-pos-q0": {"kw": "all", "pos": True, "query_kw": None},
}


def _pruned(text: Column, kw: str | None, pos: bool, low: bool, whole: bool, parts: Column | None = None) -> Column:
    table = sorted(KEYWORDS | EXTRA_KEYWORDS) if kw == "all" else sorted(KEYWORDS)
    bad = lambda t: t.isin(table) | t.rlike("^[0-9]+$")

    def of_run(run: Column) -> Column:
        return F.filter(text_tokens(run, whole), lambda t: ~(bad(t) & (t == F.lower(run))))

    if kw and pos:  # only this rule asks which run a token comes from
        found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), of_run))
    else:
        found = text_tokens(text, whole) if parts is None else parts
        found = F.filter(found, lambda t: ~bad(t)) if kw else found
    return F.filter(found, lambda t: ~t.isin(sorted(LOW_SIGNAL))) if low else found


def render_body(text: Column, tier: str, declared: Column | None = None, parts: Column | None = None) -> Column:
    """The body tokens of a document in a tier; declared holds its declaration tokens where the tier uses them, parts
    text_tokens(text, False) where several tiers share them."""
    if tier == "none":
        return F.array(text)
    rule = TIERS[tier]
    parts = None if rule.get("whole") else parts
    found = _pruned(text, rule.get("kw"), rule.get("pos", False), rule.get("low", False), rule.get("whole", False), parts)
    if rule.get("decl") and declared is not None:
        hit = lambda t: F.array_contains(declared, t)
        found = F.filter(found, hit) if rule["decl"] == "only" else F.flatten(F.transform(found, lambda t: F.when(hit(t), F.array(t, t)).otherwise(F.array(t))))
    return F.array_distinct(found) if rule.get("distinct") else found


def render_query(text: Column, tier: str) -> Column:
    if tier == "none":
        return F.array(text)
    rule = TIERS[tier]
    found = _pruned(text, rule.get("query_kw", rule.get("kw")), rule.get("pos", False), rule.get("query_low", False), rule.get("whole", False))
    return F.array_distinct(found) if rule.get("query_distinct") else found


def render_path(path: Column, mode: str = "full", body_size: Column | None = None) -> Column:
    """Path tokens: full, distinct (dedupe), of the last two segments (tail), or a quarter of the body's number from
    the end (scaled). Path tokens are never pruned."""
    if mode == "tail":
        return text_tokens(tail_segments(path, 2), False)
    found = text_tokens(path, False)
    if mode == "dedupe":
        return F.array_distinct(found)
    if mode == "scaled":
        keep = F.greatest(F.lit(1), F.round(body_size * 0.25).cast("int"))
        return F.when(F.size(found) > keep, F.slice(found, F.size(found) - keep + 1, keep)).otherwise(found)
    return found


def render_document(path: Column, text: Column, tier: str, path_mode: str = "full", declared: Column | None = None) -> Column:
    body = render_body(text, tier, declared)
    if tier == "none":
        return F.concat_ws("\n", path, text)
    return F.concat_ws(" ", F.concat(render_path(path, path_mode, F.size(body)), body))
