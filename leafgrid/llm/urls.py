"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one bit vector of several 64-bit words, a state
for each literal of each rule and one before its first.  A step over a byte
shifts the vector, masks it by the byte's literals (Shift-And) and keeps states
with a ``*`` behind them; a batch of URLs advances together, so a step is a few
numpy operations for all rules and all URLs still running.

The automaton reads a canonical URL: host, a separator that no text contains,
path.  So a ``*`` before a host rule cannot reach into the path.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

STAR, ANY = -1, -2
SEPARATOR = 0xFF
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: The production rules (verdict, host, path): a rule fits its host and all
#: subdomains if the path starts with its own; the longest one decides.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Hosts blocked where no rule fits, as globs.
HOST_GLOBS = ("*casino-win.*", "*cheap-pills.*", "*spam-farm.*", "*free-bets.*", "*ads-track.*")


def glob(text: str) -> list[int]:
    """Tokens of a glob: ``*`` any bytes, ``?`` one byte, all else literal."""
    return [{42: STAR, 63: ANY}.get(b, b) for b in text.encode()]


@dataclass
class Automaton:
    """``step[b]``: states that byte b leads into; ``stay``: states that any
    byte keeps, except the separator where ``bound``; ``begin``; the accepting
    state of each rule as (word, bit)."""

    step: np.ndarray
    stay: np.ndarray
    begin: np.ndarray
    accept: list[tuple[int, int]]

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """For each text and rule whether the rule matches all of the text."""
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        first = np.concatenate([[0], np.cumsum(size)])[:-1][order]
        data = np.frombuffer(b"".join(texts), np.uint8)
        state = np.repeat(self.begin[None, :], len(texts), 0)
        running = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")
        for at, n in enumerate(running):
            byte = data[first[:n] + at]
            now = state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            kept = self.stay & np.where(byte == SEPARATOR, np.uint64(0), ~np.uint64(0))[:, None]
            state[:n] = moved & self.step[byte] | now & kept
        out = np.zeros((len(texts), len(self.accept)), bool)
        for rule, (word, bit) in enumerate(self.accept):
            out[order, rule] = state[:, word] >> np.uint64(bit) & np.uint64(1) == 1
        return out


def compile_rules(rules: Sequence[Sequence[int]]) -> Automaton:
    """The automaton of token lists.  A star does not run over the separator."""
    states = sum(1 + sum(t != STAR for t in rule) for rule in rules)
    words = max(1, -(-states // 64))
    step, stay, begin = np.zeros((256, words), np.uint64), np.zeros(words, np.uint64), np.zeros(words, np.uint64)
    accept, at = [], 0
    for rule in rules:
        begin[at // 64] |= np.uint64(1 << at % 64)
        for token in rule:
            if token == STAR:
                stay[at // 64] |= np.uint64(1 << at % 64)
                continue
            at += 1
            bytes_ = [b for b in range(256) if b != SEPARATOR] if token == ANY else [token]
            step[bytes_, at // 64] |= np.uint64(1 << at % 64)
        accept.append((at // 64, at % 64))
        at += 1
    return Automaton(step, stay, begin, accept)


def canonical(url: str | None) -> tuple[str, str]:
    """(host, path): the host runs from behind the first ``://`` up to ``/``,
    ``?``, ``#`` or the end, A-Z lower-cased; the path up to ``?``, ``#`` or the
    end.  Both are empty for null and for URLs without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def _judge(rules: Sequence[tuple[str, str, str]], globs: Sequence[str]):
    # each rule twice: for the host itself and for what ends in ".host"
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    tokens = []
    for _, host, path in ranked:
        own = [*host.encode(), SEPARATOR, *path.encode(), STAR]
        tokens += [own, [STAR, ord("."), *own]]
    tokens += [[*glob(g), SEPARATOR, STAR] for g in globs]
    automaton = compile_rules(tokens)
    names = np.array([h + p for _, h, p in ranked] + [None], object)
    verdicts = np.array([v for v, _, _ in ranked], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [canonical(u) for u in batch.column(1).to_pylist()]
            hit = automaton.match([h.encode() + bytes([SEPARATOR]) + p.encode() for h, p in parts])
            fits = hit[:, : 2 * len(ranked)].reshape(len(parts), len(ranked), 2).any(2)
            some = fits.any(1)
            best = np.where(some, fits.argmax(1) if len(ranked) else 0, len(ranked))
            blocked = hit[:, 2 * len(ranked) :].any(1)
            verdict = np.where(some, verdicts[np.minimum(best, len(ranked) - 1)] if len(ranked) else "", np.where(blocked, "block", "allow"))
            columns = [batch.column(0), *(pa.array([p[k] for p in parts], pa.string()) for k in (0, 1)), pa.array(names[best].tolist(), pa.string()), pa.array(verdict.tolist(), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "host", "path", "rule", "verdict"])

    return run


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, globs: Sequence[str] = HOST_GLOBS) -> DataFrame:
    """One row for each row of ``pages``: (id_col, host, path, rule, verdict).

    The longest fitting rule's verdict holds; where none fits (``rule`` null) a
    URL is blocked if a glob matches its host, else allowed.  Null URLs and
    such without ``://`` have an empty host and path.  Null ids and repeated
    rows are judged like others; other columns, such as the pages' content, are
    not read.  An empty table gives an empty result.
    """
    source = only(pages, id=id_col, url=url_col)
    kind = source.schema["id"].dataType.simpleString()
    made = source.mapInArrow(_judge(tuple(rules), tuple(globs)), f"id {kind}, host string, path string, rule string, verdict string")
    return made.withColumnRenamed("id", id_col)


def allowed_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", **rules) -> DataFrame:
    """The rows of ``pages`` with an allowed URL, all columns; rows that share
    an id and a URL are judged alike, so the join is on both."""
    fine = url_verdicts(pages.select(F.col(url_col), F.col(url_col).alias("_url")).distinct(), "_url", url_col, **rules).filter("verdict = 'allow'").select(F.col("_url").alias("_match"))
    return pages.join(fine, pages[f"`{url_col}`"].eqNullSafe(fine["_match"]), "left_semi")
