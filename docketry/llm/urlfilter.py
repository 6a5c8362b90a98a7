"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

All glob rules are packed, state after state, into multiword bit masks. One step
of Shift-And per byte moves every rule of every URL of a batch at once: a literal
shifts its state's bit on, a wildcard keeps it where it is. A canonical URL is its
lower-cased host followed by its path; ``*`` stands for bytes without a slash,
``**`` for any bytes and ``?`` for one byte that is no slash.

Rules of the form host/path hold for the host and all its subdomains; they turn
into two globs each, so the same automaton answers them, and the longest wins.
URLs without a rule get the verdict of the plain globs: blocked if one fits or if
there is no host, else allowed.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.columns import field, utf8
from docketry.runtime import table

#: The rules of the contract, in its order.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Bytes of automaton states held at once.
STATES = 8 << 20


def read_globs(path: str) -> list[str]:
    """The globs of a rule file, one a line; empty lines and those that begin with # are left out."""
    with open(path, encoding="utf-8") as f:
        return [line for line in (x.strip() for x in f) if line and not line.startswith("#")]


#: What is blocked where no rule decides: the rule file beside this module, or another's.
BLOCKED = read_globs(os.path.join(os.path.dirname(__file__), "url_rules.txt"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class GlobAutomaton:
    """Shift-And masks of several globs; ``match`` runs them over a batch of strings."""

    def __init__(self, globs: Sequence[str]):
        literals: list[list[tuple[int, set[int]]]] = []  # of each state: what keeps it, what led to it
        self.last, size = [], 0
        for glob in globs:
            states, b, i = [[0, None]], glob.encode(), 0
            while i < len(b):
                if b[i] == ord("*"):
                    wide = b[i : i + 2] == b"**"
                    states[-1][0] = max(states[-1][0], 2 if wide else 1)
                    i += 1 + wide
                else:
                    states.append([0, b[i]])
                    i += 1
            literals.append(states)
            size += len(states)
            self.last.append(size - 1)
        self.words = max(1, -(-size // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.keep = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        at = 0
        for states in literals:
            self.start[at // 64] |= np.uint64(1 << at % 64)
            for keeps, byte in states:
                word, bit = at // 64, np.uint64(1 << at % 64)
                if keeps:
                    self.keep[:, word] |= bit
                    if keeps == 1:
                        self.keep[ord("/"), word] &= ~bit
                if byte == ord("?"):
                    self.step[:, word] |= bit
                    self.step[ord("/"), word] &= ~bit
                elif byte is not None:
                    self.step[byte, word] |= bit
                at += 1

    def match(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A boolean of each string and glob; states of at most about STATES bytes are held at once."""
        n, rows = len(offsets) - 1, max(64, STATES // (8 * self.words))
        parts = [self._match(flat, offsets[at : min(n, at + rows) + 1]) for at in range(0, n, rows)]
        return np.concatenate([*parts, np.zeros((0, len(self.last)), bool)])

    def _match(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = offsets[:-1][order], lengths[order]
        state = np.tile(self.start, (len(order), 1))
        active, at = int(np.count_nonzero(lengths)), 0
        while active:
            now, byte = state[:active], flat[starts[:active] + at]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:active] = (moved & self.step[byte]) | (now & self.keep[byte])
            at += 1
            active = int(np.searchsorted(-lengths, -at, "left"))
        out = np.empty((len(order), len(self.last)), bool)
        for g, bit in enumerate(self.last):
            out[order, g] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for strings without ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def filter_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    blocked: Sequence[str] = BLOCKED,
) -> DataFrame:
    """One row per page: its id, host, path, rule (null if none fits) and verdict.

    A null, empty or relative url has an empty host and path, fits no rule and is
    blocked. Ties between rules of one length go to the one listed first. Repeated
    rows are judged each; a null id stays null; an empty table gives an empty
    result; further columns are not carried, so their names cannot clash.
    """
    rules, blocked = list(rules), list(blocked)
    by_length = sorted(range(len(rules)), key=lambda i: -len(rules[i][1]))
    rule_globs = [f"{at}{rules[i][1]}**" for i in by_length for at in ("", "*.")]
    names = np.array([rules[i][1] for i in by_length] + [None], object)
    actions = np.array([rules[i][0] for i in by_length] + [""], object)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton(rule_globs + blocked)
        for batch in batches:
            flat, offsets = utf8(batch.column(3))
            hit = automaton.match(flat, offsets)
            ruled = hit[:, : len(rule_globs)].reshape(len(hit), -1, 2).any(2)
            ruled = np.concatenate([ruled, np.ones((len(hit), 1), bool)], 1)
            first = ruled.argmax(1)
            empty = np.diff(utf8(batch.column(1))[1]) == 0
            plain = np.where(hit[:, len(rule_globs) :].any(1) | empty, "block", "allow")
            verdict = np.where(first == len(rules), plain, actions[first])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(names[first], pa.string()), pa.array(verdict, pa.string())],
                ["id", "host", "path", "rule", "verdict"],
            )

    host, path = host_and_path(F.col(url_col))
    return (
        pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
        .withColumn("canonical", F.concat("host", "path"))
        .mapInArrow(judge, f"{field(pages.schema, id_col, 'id')}, host string, path string, rule string, verdict string")
        .withColumnRenamed("id", id_col)
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def glob_regex(glob: str) -> str:
    """The glob as a regular expression for whole strings, for the SQL."""
    meant = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "".join(meant.get(x, re.escape(x)) for x in re.split(r"(\*\*|\*|\?)", glob))


QUERIES = {"op5_url_filters": op5_url_filters}
ORACLE = {
    "op5_url_filters": rf"""
with u as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
r as (
  select *, case
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule
  from u)
select page_id, host, path, rule, case
    when rule in ('org/', 'com/fr/') then 'allow'
    when rule is not null then 'block'
    when host = '' or regexp_matches(host || path, '(?s)^({"|".join(map(glob_regex, BLOCKED))})$')
      then 'block' else 'allow' end as verdict
from r"""
}
