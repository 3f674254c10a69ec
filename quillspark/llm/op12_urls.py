"""Operator 12: URL filters by a bit-parallel wildcard automaton.

A URL's canonical form is its host in lower case and its path, without scheme, query and fragment.  Rules are globs over it:
``*`` is any run without a slash, ``**`` any run, ``?`` one character but a slash, everything else itself; a glob fits whole forms.
All globs are packed into one bit vector of several 64-bit words.  A state is reached by its character (Shift-And), and
stays where a wildcard follows it, so one shift, two masks of the character and an or move all patterns at once; a
task moves all URLs of a batch together, character by character.  The last state of a glob says that it fits.

Of the rules that fit a URL, the highest level wins, then the longest name, then the first of the list.

Defined results: a null URL and one without ``://`` have an empty host and path, which only the empty glob and bare ``**`` fit; an empty
table gives no row; repeated rows are judged alike; very long URLs are read whole, by the same automaton on one large integer; ties
go to the first rule; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches

#: Rows that are moved together; a batch of them is a matrix of so many rows of words.
ROWS = 4096
#: Bytes from which a form is read alone.
LONG = 2048
U64 = np.uint64


@dataclass(frozen=True)
class Rule:
    """Verdict of a form that one of the globs fits."""

    name: str
    verdict: str
    globs: tuple[str, ...]
    level: int = 0


def site_rule(verdict: str, name: str, level: int = 1) -> Rule:
    """``host/path``: the host and all its subdomains, paths that begin so."""
    return Rule(name, verdict, (f"{name}**", f"*.{name}**"), level)


#: The contract's rules (fixed values), above screens of this library's choice for what they leave open.
SITES = (site_rule("allow", "com/"), site_rule("block", "example.com/en/"), site_rule("allow", "www.example.com/en/"), site_rule("block", "net/es/"), site_rule("block", "net/fr/"))
SCREENS = (
    Rule("no address", "block", ("",)),
    Rule("adverts", "block", ("ads-*.*", "ads-*.*/**", "*.ads-*.*", "*.ads-*.*/**", "ads.*", "ads.*/**", "*.ads.*", "*.ads.*/**")),
    Rule("betting", "block", ("*-bets.*", "*-bets.*/**", "*casino*", "*casino*/**")),
    Rule("forms", "block", ("*/**/login*", "*/login*", "*/**/cart/**", "*/cart/**", "*/**/checkout/**", "*/checkout/**")),
    Rule("binaries", "block", ("*/**.exe", "*/**.zip", "*/**.iso", "*/**.mp?")),
)


class Automaton:
    """The masks of all globs of some rules."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        order = sorted(range(len(rules)), key=lambda i: (-rules[i].level, -len(rules[i].name), i))
        step, stay = [0] * 256, [0] * 256
        start, at, ends = 0, 0, []
        slash, follow = ord("/"), range(0x80, 0xC0)  # bytes that go on with a character
        for rule in order:
            for glob in rules[rule].globs:
                start |= 1 << at
                for part in _parts(glob):
                    if part == "**" or part == "*":
                        for b in range(256):
                            if part == "**" or b != slash:
                                stay[b] |= 1 << at
                        continue
                    at += 1
                    if part == "?":
                        for b in range(256):
                            if b != slash and b not in follow:
                                step[b] |= 1 << at
                        for b in follow:
                            stay[b] |= 1 << at
                    else:
                        step[part] |= 1 << at
                ends.append((at, rule))
                at += 1
        self.size = at
        self.step, self.stay, self.start = step, stay, start
        self.by_rule: list[tuple[int, int]] = []  # (accepting states, rule), the winner first
        for rule in order:
            self.by_rule.append((sum(1 << e for e, r in ends if r == rule), rule))
        self.words = max(1, -(-at // 64))
        self.steps, self.stays = self._words(step), self._words(stay)
        self.starts = self._words([start])[0]

    def _words(self, masks: list[int]) -> np.ndarray:
        return np.array([[(m >> (64 * w)) & (2**64 - 1) for w in range(self.words)] for m in masks], U64)

    def decide(self, states: int) -> int:
        """The rule that wins in a set of states; -1 if none accepts."""
        return next((rule for accept, rule in self.by_rule if states & accept), -1)

    def match(self, form: bytes) -> int:
        """The rule of one form, on one large integer."""
        states, step, stay = self.start, self.step, self.stay
        for b in form:
            states = ((states << 1) & step[b]) | (states & stay[b])
        return self.decide(states)

    def match_many(self, forms: list[bytes]) -> np.ndarray:
        """The rule of each form: all move together, the longest last."""
        size = np.array([len(f) for f in forms], np.int64)
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(forms), np.uint8)
        at = (np.cumsum(size) - size)[order]
        size = size[order]
        states = np.repeat(self.starts[None, :], len(forms), axis=0)
        for i in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -i))  # forms of more than i bytes come first
            now = states[:n]
            b = data[at[:n] + i]
            moved = now << U64(1)
            moved[:, 1:] |= now[:, :-1] >> U64(63)
            states[:n] = (moved & self.steps[b]) | (now & self.stays[b])
        out = np.full(len(forms), -1, np.int64)
        open_ = np.ones(len(forms), bool)
        for accept, rule in self.by_rule:
            hit = open_ & (states & self._words([accept])[0]).any(axis=1)
            out[order[hit]] = rule
            open_ &= ~hit
        return out


def _parts(glob: str) -> Iterator[str | int]:
    """Wildcards, and the bytes of everything else."""
    i = 0
    while i < len(glob):
        if glob[i] == "*":
            wide = glob[i : i + 2] == "**"
            yield "**" if wide else "*"
            i += 1 + wide
        elif glob[i] == "?":
            yield "?"
            i += 1
        else:
            yield from glob[i].encode()
            i += 1


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, fits, level, verdict): the winning rule's name and level, null where none fits, and the verdict."""
    spark = pages.sparkSession
    arrow_batches(spark, ROWS)
    host, path = split_url(F.col(url_col).cast("string"))
    automaton = Automaton(tuple(rules))
    names = pa.array([r.name for r in rules] + [None], pa.string())
    levels = pa.array([r.level for r in rules] + [None], pa.int32())
    verdicts = pa.array([r.verdict for r in rules] + [default], pa.string())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [h.encode() + p.encode() for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            long = [i for i, f in enumerate(forms) if len(f) > LONG]
            alone = [automaton.match(forms[i]) for i in long]
            for i in long:
                forms[i] = b""
            rule = automaton.match_many(forms)
            rule[long] = alone
            rule[rule < 0] = len(rules)
            take = pa.array(rule)
            yield pa.RecordBatch.from_arrays([*batch.columns, names.take(take), levels.take(take), verdicts.take(take)], ["page_id", "host", "path", "fits", "level", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    src = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    return src.mapInArrow(judge, f"page_id {kind}, host string, path string, fits string, level int, verdict string")


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's rule is one of the sites'; where none fits, screens decide, and what they leave is allowed."""
    judged = filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), SITES + SCREENS)
    return judged.select("page_id", "host", "path", F.when(F.col("level") == 1, F.col("fits")).alias("rule"), "verdict", F.when(F.col("level") == 0, F.col("fits")).alias("screen"))
