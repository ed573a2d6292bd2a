"""Secrets in texts: three patterns, and strings whose sliding-window Shannon entropy is that of keys.

A candidate is a run of one character class with enough characters. A window slides along it; the counts of its symbols, and
with them its entropy, change by the one that enters and the one that leaves. Windows at or above the class's entropy join to
spans. An allow-list keeps known harmless strings from being reported; it never touches the patterns' matches.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import ending, own_columns, slices

#: The patterns of the contract, the group that has a least length, and that length.
PATTERNS = {
    "assign": (re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile("[0-9a-f]{24,}"), 0, 24),
}


@dataclass(frozen=True)
class CharClass:
    """A class of characters, the window that slides over its runs, the bits a character that a window needs, and what a reported span must hold."""

    kind: str
    chars: str
    window: int
    bits: float
    needs: tuple[str, ...]


#: Narrower classes first: what one of them reports, a wider one doesn't report again.
CLASSES = (
    CharClass("entropy_hex", "0-9a-fA-F", 20, 3.0, ("[0-9]", "[a-fA-F]")),
    CharClass("entropy_alnum", "0-9A-Za-z", 24, 3.8, ("[0-9]", "[A-Za-z]")),
    CharClass("entropy_base64", "0-9A-Za-z+/_=-", 24, 3.9, ("[0-9]", "[A-Z]", "[a-z]")),
)
#: A candidate that one of these matches whole or in part is harmless.
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|redacted",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",  # identifiers
    r"(?i)abcdefghijkl|0123456789|qwertyuiop",
    r"^/?(?:[A-Za-z]+\d{0,2}[-_/])+(?:[A-Za-z]+\d{0,2})?$",  # words joined by signs: paths, slugs
)
MOST = "A-Za-z0-9+/_=-"


def hot_windows(text: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Spans that the windows of at least so many bits a character cover; one pass with incremental counts."""
    cost = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]  # one more while a symbol enters
    counts: dict[str, int] = {}
    total, out = 0.0, []
    bound = window * (math.log2(window) - bits) + 1e-9
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += cost[c + 1] - cost[c]
        if i >= window:
            old = text[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += cost[c - 1] - cost[c]
        if i >= window - 1 and total <= bound:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def scanner(classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> Callable[[str], tuple[list, list]]:
    """A function from a text to its pattern matches and its entropy spans, each a list of (kind, start, end) in code points."""
    runs = [(c, re.compile(f"[{c.chars}]{{{c.window},}}"), [re.compile(n) for n in c.needs]) for c in classes]
    widest = re.compile(f"[{MOST}]{{{min(c.window for c in classes)},}}") if classes else None
    harmless = [re.compile(a) for a in allowed]

    def scan(text: str) -> tuple[list, list]:
        base = [(kind, m.start(), m.end()) for kind, (pattern, group, least) in PATTERNS.items() for m in pattern.finditer(text) if len(m[group]) >= least]
        found: list[tuple[str, int, int]] = []
        for whole in widest.finditer(text) if widest else ():
            if any(a.search(whole[0]) for a in harmless):
                continue
            for c, run, needs in runs:
                for m in run.finditer(text, whole.start(), whole.end()):
                    if not any(s <= m.start() and m.end() <= e for _, s, e in found):
                        spans = ((m.start() + s, m.start() + e) for s, e in hot_windows(m[0], c.window, c.bits))
                        found += [(c.kind, s, e) for s, e in spans if all(n.search(text, s, e) for n in needs) and not any(s < b and a < e for _, a, b in found)]
        return base, found

    return scan


def joined(spans: list, kinds: list[str]) -> str:
    """kind:start:end by start, then in the kinds' order, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]), x[2])))


OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"


def scan_secrets(docs: DataFrame, classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """doc_id, counts of each pattern, the digest of their spans, all spans and the number of entropy spans, a row a row of docs.

    Whole texts are read, of any length and at a cost in proportion to it; a null text counts as empty, a null doc_id stays
    null, repeated rows are scanned each, an empty table stays empty and other columns are not read. Spans are start and end,
    in code points, end exclusive; those of a pattern are its whole match. No shuffle.
    """
    kinds = [*PATTERNS, *(c.kind for c in classes)]
    least = min([24, *(c.window for c in classes)])
    maybe = rf"(?i)password|passwd|secret|token|api_?key|AKIA|[{MOST}]{{{least}}}"  # no text without it has a span

    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, digest = scanner(classes, allowed), lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for part in slices(batch, text=1):
                rows = []
                looked = pc.fill_null(pc.match_substring_regex(part.column(1), maybe), False).to_numpy(zero_copy_only=False)
                for i, look in enumerate(looked):
                    base, more = scan(part.column(1)[i].as_py()) if look else ([], [])
                    n = [sum(k == kind for k, _, _ in base) for kind in PATTERNS]
                    rows.append((*n, digest(joined(base, kinds)), joined(base + more, kinds), len(more)))
                kinds_of = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds_of, strict=True)] if rows else [pa.array([], t) for t in kinds_of]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *columns], [f.split()[0] for f in OUT.split(", ")])

    return own_columns(docs, "doc_id", "text").mapInArrow(lambda b: ending(scan_batches(b)), OUT)
