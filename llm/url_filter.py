"""URL filters by a bit-parallel wildcard automaton.

Rules are glob patterns over a URL's canonical form ``.host/path``.  All patterns lie in
one row of machine words, a bit for each place in a pattern; one Shift-And step moves
every pattern over one byte at once, and ``*`` is a place that stays set on the bytes it
may eat.  A batch of URLs runs side by side, one byte of each in a step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, table


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and a path that the URL's path starts with."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        """``*`` eats no slash, ``**`` anything."""
        return f"*.{self.host}{self.path}**"


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))
DEFAULT = "allow"


class ShiftAnd:
    """Many glob patterns in one multiword automaton; whole strings are matched."""

    def __init__(self, globs: list[str]):
        starts, ends, steps, loops, bit = [], [], [], [], 0
        anything, no_slash = np.ones(256, bool), np.ones(256, bool)
        no_slash[ord("/")] = False
        for glob in globs:
            starts.append(bit)
            raw, k = glob.encode("utf-8"), 0
            while k < len(raw):
                if raw[k] == ord("*"):
                    two = raw[k : k + 2] == b"**"
                    loops.append((bit, anything if two else no_slash))
                    k += 1 + two
                    continue
                bit += 1
                steps.append((bit, raw[k]))
                k += 1
            ends.append(bit)
            bit += 1
        self.words = bit // 64 + 1
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        one = lambda b: np.uint64(1 << (b % 64))
        for b, c in steps:
            self.step[c, b // 64] |= one(b)
        for b, eats in loops:
            self.stay[eats, b // 64] |= one(b)
        for b in starts:
            self.first[b // 64] |= one(b)
        self.ends = np.array(ends, np.int64)

    def match(self, texts: list[bytes]) -> np.ndarray:
        """A row of booleans, one for each pattern, for each text."""
        n = len(texts)
        out = np.zeros((n, len(self.ends)), bool)
        if not n:
            return out
        size = np.array([len(t) for t in texts])
        order = np.argsort(-size, kind="stable")
        size = size[order]
        data = np.frombuffer(b"".join(texts), np.uint8)
        start = np.concatenate(([0], np.cumsum([len(t) for t in texts])))[:-1][order]
        state = np.tile(self.first, (n, 1))
        live = n
        for k in range(int(size[0]) if n else 0):
            while live and size[live - 1] <= k:
                live -= 1
            c = data[start[:live] + k]
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[c]) | (now & self.stay[c])
        bits = (state[:, self.ends // 64] >> (self.ends % 64).astype(np.uint64)) & np.uint64(1)
        out[order] = bits.astype(bool)
        return out


def _judge(rules: tuple[Rule, ...], default: str):
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.name))

    def run(batches):
        automaton = ShiftAnd([r.glob for r in ranked])
        for batch in batches:
            host, path = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            hit = automaton.match([f".{h}{p}".encode("utf-8", "surrogatepass") for h, p in zip(host, path)])
            first = np.where(hit.any(axis=1), hit.argmax(axis=1), -1) if len(ranked) else np.full(len(host), -1)
            rule = [ranked[i].name if i >= 0 else None for i in first]
            verdict = [ranked[i].verdict if i >= 0 else default for i in first]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*batch.schema.names, "rule", "verdict"])

    return run


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = DEFAULT, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (of the longest that fits, or null) and verdict.

    * null urls and such without ``://`` have empty host and path and fit no rule;
    * of rules as long, the first by name wins; repeated rows are judged alike;
    * columns of these four names are replaced; an empty table is fine.  No shuffle.
    """
    bound_batches(pages.sparkSession)
    url = F.col(url_col)
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    rest = F.when(rest.isNotNull(), F.substr(url, F.length(rest) + 4)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    df = pages.select(*kept, low.alias("host"), path.alias("path"))
    schema = T.StructType([*df.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return df.mapInArrow(_judge(tuple(rules), default), schema)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM cut),
urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path
  FROM parts),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM urls u LEFT JOIN fit f USING (page_id)
"""
