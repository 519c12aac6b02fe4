"""Cutting long texts into parts in one pass: blocks by the class of their paragraphs, pages, pieces.

Where a part ends depends on where the one before it ended.  As an expression of the JVM that is a
fold which copies what it has built at each step, so its time grows with the square of the text;
here each text is walked once, on Arrow batches, in time and memory proportional to it."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at the edges of a part.
WHITE = " \t\n\r\f\v"
#: Unicode's spaces (category Zs), which a plain trim of the queries' SQL takes off; tabs are none.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Bytes of text that a worker turns into Python's strings at once; bounds its memory.
SLICE = 1 << 19
_ARROW = {"array<string>": pa.list_(pa.string()), "array<struct<kind:string,text:string>>": pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))}
_BLANK = re.compile(r"\n[ \t]*\n")

Classes = list[tuple[str, re.Pattern[str]]]


def blocks(text: str | None, classes: Classes, rest: str, takes: set[str]) -> list[tuple[str, str]] | None:
    """Paragraphs with the first class whose pattern they begin with (else ``rest``); what is of
    class ``rest`` joins the block before it if that is of a class in ``takes``."""
    if text is None:
        return None
    out: list[tuple[str, list[str]]] = []
    for p in (x.strip(SPACES) for x in _BLANK.split(text)):
        if not p:
            continue
        kind = next((name for name, pattern in classes if pattern.match(p)), rest)
        if kind == rest and out and out[-1][0] in takes:
            out[-1][1].append(p)
        else:
            out.append((kind, [p]))
    return [(kind, "\n".join(parts)) for kind, parts in out]


def pages(text: str | None, size: int) -> list[str] | None:
    """Lines packed into pages of at most ``size`` characters with their line ends; a text of up to
    1.2 pages stays whole, and so does a line that is longer than a page."""
    if text is None or len(text) <= size * 1.2:
        return None if text is None else [text]
    out: list[list[str]] = []
    used = 0
    for line in (x.strip(SPACES) for x in text.split("\n")):
        if not line:
            continue
        if not out or used + len(line) + 1 > size:
            out.append([])
            used = 0
        out[-1].append(line)
        used += len(line) + 1
    return ["\n".join(page) for page in out]


def pieces(text: str | None, size: int) -> list[str]:
    """Pieces of at most ``size`` characters, each ending at the last blank line that lies in its
    reach and beyond its first third, if there is one."""
    whole = (text or "").strip(WHITE)
    blank = [m.start() for m in re.finditer("(?=\n\n)", whole)]
    out, at = [], 0
    while at < len(whole):
        reach = at + size
        near = bisect_right(blank, reach - 2) - 1 if reach < len(whole) else -1
        end = blank[near] if near >= 0 and blank[near] > at + size // 3 else min(reach, len(whole))
        out.append(whole[at:end].strip(WHITE))
        at = end
    return [p for p in out if p]


def each(text: Column, cut: Callable[[str | None], list | None], kind: str) -> Column:
    """``cut`` of every text, as a column of type ``kind``.

    A batch has thousands of texts, whole ones; they become Python's strings about SLICE characters
    at a time, so that a worker holds a batch in Arrow's form only."""
    made = _ARROW[kind]

    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([cut(t) for t in part.to_pylist()], made) for part in parts(texts)])

    return F.arrow_udf(run, kind)(text)


def parts(texts: pa.Array) -> list[pa.Array]:
    """The texts in order, in slices that end after the text with which they reach SLICE; one empty
    slice without any text."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    out, at, held = [], 0, 0
    for i, n in enumerate(size):
        held += n
        if held >= SLICE:
            out.append(texts.slice(at, i + 1 - at))
            at, held = i + 1, 0
    if at < len(texts) or not out:
        out.append(texts.slice(at))
    return out
