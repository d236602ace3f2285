"""URL filtering by globs, all of them simulated at once with bit-parallel Shift-And.

A URL is brought to the form ``.host#path``: the dot lets ``*.net`` stand for a host and all its
subdomains, and ``#`` can occur in neither part, so a ``*`` in front of it never leaves the host.
Every glob is laid out as one start bit and one bit per character in a row of 64-bit words; ``*``
is a bit that stays set on any character, ``?`` a bit that any character sets. One shift, one mask
lookup and one OR per character move all globs of all URLs of a batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import code_points

CELLS = 4_000_000  # characters of a block of URLs, padded to its longest


@dataclass(frozen=True)
class Rule:
    """``host/path`` with the verdict for the host, its subdomains and all paths that start so."""

    rule: str
    verdict: str

    def glob(self) -> str:
        host, _, path = self.rule.partition("/")
        return f"*.{host}#/{path}*"


@dataclass(frozen=True)
class Glob:
    """A glob over ``.host#path`` with the verdict for what no rule fits."""

    glob: str
    verdict: str


# --- fixed values: the rules asked for -----------------------------------------------------
RULES = (
    Rule("net/", "block"),
    Rule("example.net/en/", "allow"),
    Rule("example.com/de/", "block"),
    Rule("org/fr/", "allow"),
)
# -------------------------------------------------------------------------------------------
GLOBS = (
    Glob("*.cheap-pills.*", "block"),
    Glob("*.spam-*", "block"),
    Glob("*casino*#*", "block"),
    Glob("*#*.exe", "block"),
    Glob("*#*/wp-login.???", "block"),
)
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#``, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


class Automaton:
    """Shift-And masks of many globs."""

    def __init__(self, globs: Iterable[str]):
        layout: list[str | None] = []  # what each bit reads: None starts a glob
        loops: list[int] = []
        starts, self.final = [], []
        for glob in globs:
            starts.append(len(layout))
            layout.append(None)
            for c in glob:
                if c == "*":
                    loops.append(len(layout) - 1)
                else:
                    layout.append(c)
            self.final.append(len(layout) - 1)
        self.words = max(1, -(-len(layout) // 64))
        letters = sorted({ord(c) for c in layout if c is not None and c != "?"})
        self.letters = np.array(letters, dtype=np.uint32)
        self.start, self.loop = self._bits(starts), self._bits(loops)
        anything = self._bits(i for i, c in enumerate(layout) if c == "?")
        # row 0: a character of no glob
        self.mask = np.stack([anything, *(anything | self._bits(i for i, c in enumerate(layout) if c == chr(x)) for x in letters)])

    def _bits(self, places: Iterable[int]) -> np.ndarray:
        out = np.zeros(self.words, dtype=np.uint64)
        for p in places:
            out[p // 64] |= np.uint64(1) << np.uint64(p % 64)
        return out

    def matches(self, texts: list[str]) -> np.ndarray:
        """Boolean matrix, a row per text and a column per glob."""
        out = np.zeros((len(texts), len(self.final)), dtype=bool)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(texts[order[end]]) <= CELLS:
                end += 1
            block = order[at:end]
            out[block] = self._run([texts[i] for i in block])
            at = end
        return out

    def _run(self, texts: list[str]) -> np.ndarray:
        lengths = np.array([len(t) for t in texts])
        flat = code_points("".join(texts))
        place = np.searchsorted(self.letters, flat)
        known = np.zeros(len(flat), dtype=bool) if not len(self.letters) else self.letters[np.minimum(place, len(self.letters) - 1)] == flat
        kind = np.where(known, place + 1, 0)
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        state = np.tile(self.start, (len(texts), 1))
        carry = np.zeros_like(state)
        one, top = np.uint64(1), np.uint64(63)
        live = 0  # texts are sorted by length: those before ``live`` have ended
        for step in range(int(lengths.max(initial=0))):
            while lengths[live] <= step:
                live += 1
            now = state[live:]
            carry[live:, 1:] = now[:, :-1] >> top
            state[live:] = (((now << one) | carry[live:]) & self.mask[kind[begin[live:] + step]]) | (now & self.loop)
        words = np.array([f // 64 for f in self.final], dtype=int)
        shifts = np.array([f % 64 for f in self.final], dtype=np.uint64)
        return ((state[:, words] >> shifts) & one).astype(bool) if self.final else np.zeros((len(texts), 0), dtype=bool)


def url_filter(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: tuple[Rule, ...] = RULES,
    globs: tuple[Glob, ...] = GLOBS,
    default: str = DEFAULT,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, glob.

    The longest fitting rule decides; where none fits, the first fitting glob; else ``default``.
    ``rule`` and ``glob`` are null where they did not decide. A null or empty URL, or one without
    ``://``, has an empty host and path. Repeated rows stay as they are, an empty table gives an
    empty one, other columns are not read. The rules are a stated list, not data: the masks take
    16 bytes per rule character and distinct letter.
    """
    everything = [r.glob() for r in rules] + [g.glob for g in globs]
    by_length = sorted(range(len(rules)), key=lambda i: -len(rules[i].rule))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(everything)
        for batch in batches:
            ids, hosts, paths = (batch.column(i) for i in range(3))
            texts = [f".{h}#{p}" for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
            fits = automaton.matches(texts)
            rule, glob, verdict = [], [], []
            for row in fits:
                r = next((i for i in by_length if row[i]), None)
                g = None if r is not None else next((i for i in range(len(globs)) if row[len(rules) + i]), None)
                rule.append(None if r is None else rules[r].rule)
                glob.append(None if g is None else globs[g].glob)
                verdict.append(rules[r].verdict if r is not None else globs[g].verdict if g is not None else default)
            text = [pa.array(x, pa.string()) for x in (rule, verdict, glob)]
            yield pa.RecordBatch.from_arrays([ids, hosts, paths, *text], names=[id_col, "host", "path", "rule", "verdict", "glob"])

    url = F.coalesce(F.col(url_col), F.lit(""))
    wanted = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    kind = wanted.schema[id_col].dataType.simpleString()
    return wanted.mapInArrow(judge, f"{id_col} {kind}, host string, path string, rule string, verdict string, glob string")
